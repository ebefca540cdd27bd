"""Queries over text, streams, labellings, mixtures, graphs, series and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.functions import vectors as V
from patternloom.operators import cluster, drift, explain, graph, mixture, recsys, series, stability, text
from patternloom.operators.iterate import scratch, settle
from patternloom.plans.registry import DAILY, HOURLY, MATRIX, SCORES, query, rounded, rounded_sql
from patternloom.plans.tables import COLS, NEAR, flat, lloyd_sql
from patternloom.sources import features as S
from patternloom.sources import generators
from patternloom.streaming import live


def docs(s, d) -> DataFrame:
    return S.table(s, d, "documents")


def words(column: str = "text") -> str:
    clean = rf"trim(regexp_replace(regexp_replace(lower(coalesce({column}, '')), '[^a-z\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
    return clean


TOKENS = f"SELECT doc_id AS doc, term FROM (SELECT doc_id, unnest(string_split({words()}, ' ')) AS term FROM documents) WHERE length(term) >= 2"
CELLS = f"SELECT doc, term, count(*) AS n FROM ({TOKENS}) GROUP BY 1, 2"
VOCAB = f"SELECT term, count(*) AS df FROM ({CELLS}) GROUP BY 1 HAVING count(*) >= {{0}}"
query("N1_clean_text", lambda s, d: docs(s, d).select("doc_id", text.clean(F.col("text")).alias("text")), f"SELECT doc_id, {words()} AS text FROM documents")
query("N3_count_matrix", lambda s, d: (lambda c: c.join(text.vocabulary(c, 20).select("term"), "term", "left_semi").select("doc", "term", "n"))(settle(text.counts(docs(s, d)))), f"SELECT * FROM ({CELLS}) WHERE term IN (SELECT term FROM ({VOCAB.format(20)}))")
TFIDF = f"""WITH c AS ({CELLS}), v AS ({VOCAB.format(2)}), t AS (SELECT count(DISTINCT doc) AS total FROM c),
w AS (SELECT doc, term, n * (ln((1e0 + t.total) / (1 + df)) + 1) AS w FROM c JOIN v USING (term), t)
SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM w"""
query("N2_tfidf", lambda s, d: rounded(text.tfidf(text.counts(docs(s, d)))), rounded_sql(TFIDF, ["weight"]))
STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
PAIRED = f"""SELECT doc, term, count(*) AS n FROM (
  SELECT doc, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
  FROM (SELECT doc_id AS doc, list_filter(string_split({words()}, ' '), lambda w: length(w) >= 2 AND w NOT IN ({STOP})) AS t FROM documents)) GROUP BY 1, 2"""
query(
    "N2_tfidf_of_word_pairs",
    lambda s, d: rounded(text.tfidf(text.counts(docs(s, d), ngrams=2, stop=text.STOP_WORDS), 2, 0.9)),
    rounded_sql(TFIDF.replace(CELLS, PAIRED).replace(f"({VOCAB.format(2).replace(CELLS, PAIRED)})", f"({VOCAB.format(2).replace(CELLS, PAIRED)} AND count(*) <= 0.9e0 * (SELECT count(DISTINCT doc) FROM ({PAIRED})))"), ["weight"]),
)


def components(s, d, cells: DataFrame | None = None) -> DataFrame:
    """Languages as topics: how often each has each term."""
    c = (cells or text.counts(docs(s, d))).join(docs(s, d).select(F.col("doc_id").alias("doc"), F.col("lang").alias("topic")), "doc")
    return c.groupBy("topic", "term").agg(F.sum("n").cast("double").alias("weight"))


TOPICS = f"SELECT lang AS topic, term, CAST(sum(n) AS DOUBLE) AS weight FROM ({CELLS}) JOIN documents ON doc_id = doc GROUP BY 1, 2"
TOP = f"SELECT topic, CAST(row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) - 1 AS INTEGER) AS rank, term, weight FROM ({TOPICS}) QUALIFY rank < {{0}}"
query("N6_topic_term_table", lambda s, d: text.topic_terms(components(s, d)), TOP.format(10))
query("N7_label_topics", lambda s, d: text.topic_labels(components(s, d)), f"SELECT topic, string_agg(term, ' / ' ORDER BY rank) AS label FROM ({TOP.format(3)}) GROUP BY 1")
query(
    "N8_top_terms_by_component",
    lambda s, d: text.topic_terms(components(s, d), 5).groupBy("topic").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]), ",").alias("terms")),
    f"SELECT topic, string_agg(term, ',' ORDER BY rank) AS terms FROM ({TOP.format(5)}) GROUP BY 1",
)
ROLES = ["user", "assistant", "system"]
query(
    "N9_assign_documents",
    lambda s, d: rounded(
        text.assign_documents(S.table(s, d, "conversations").groupBy(F.col("conv_id").alias("doc")).agg(F.array(*(F.sum((F.col("role") == r).cast("double")) for r in ROLES)).alias("weights")))
    ),
    f"""WITH w AS (SELECT conv_id AS doc, [{', '.join(f"sum(CAST(role = '{r}' AS DOUBLE))" for r in ROLES)}] AS w FROM conversations GROUP BY 1)
SELECT doc, CAST(list_position(w, list_max(w)) - 1 AS INTEGER) AS topic, round(CASE WHEN list_sum(w) > 0 THEN list_max(w) / list_sum(w) ELSE 0 END, 6) AS confidence FROM w""",
)
query(
    "N10_umass_coherence",
    lambda s, d: (lambda c: rounded(text.umass_coherence(text.topic_terms(components(s, d, c), 8), c)))(settle(text.counts(docs(s, d)))),
    f"""WITH c AS ({CELLS}), t AS ({TOP.format(8)}), k AS (SELECT topic, rank, term, (SELECT count(*) FROM c WHERE c.term = t.term) AS d FROM t),
p AS (SELECT a.topic, a.term AS ti, b.term AS tj, a.d FROM k a JOIN k b ON a.topic = b.topic AND a.rank < b.rank),
x AS (SELECT a.term AS ti, b.term AS tj, count(*) AS dij FROM c a JOIN c b ON a.doc = b.doc AND a.term <> b.term WHERE a.term IN (SELECT term FROM t) AND b.term IN (SELECT term FROM t) GROUP BY 1, 2)
SELECT topic, round(avg(ln((coalesce(dij, 0) + 1e0) / d)), 6) AS coherence FROM p LEFT JOIN x USING (ti, tj) GROUP BY 1""",
)
query("N11_topic_diversity", lambda s, d: rounded(text.topic_diversity(text.topic_terms(components(s, d)))), f"SELECT round(count(DISTINCT term) / CAST(count(*) AS DOUBLE), 6) AS diversity FROM ({TOP.format(10)})")
TALK = f"SELECT conv_id * 1000 + turn AS doc, unnest(string_split({words()}, ' ')) AS term FROM conversations"
query(
    "N12_vocab_drift_nnz",
    lambda s, d: text.known_terms(
        S.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text"), text.vocabulary(text.counts(docs(s, d)), 5)
    ).select("doc", "n_known"),
    f"SELECT doc, count(DISTINCT term) FILTER (length(term) >= 2 AND term IN (SELECT term FROM ({VOCAB.format(5)}))) AS n_known FROM ({TALK}) GROUP BY 1",
)
query("N13_truncate", lambda s, d: text.truncated(docs(s, d)), f"SELECT doc_id AS doc, array_to_string(string_split({words()}, ' ')[1:3], ' ') AS text FROM documents")
query(
    "N14_vocab_diff",
    lambda s, d: (lambda c: text.vocabulary(c, 2).select("term").exceptAll(text.vocabulary(c, 10).select("term")))(text.counts(docs(s, d))),
    f"SELECT term FROM ({VOCAB.format(2)}) WHERE df < 10",
)


def topics(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The weighed corpus without stop words, and three topics: rows' and terms' factors."""
    cells = settle(text.tfidf(text.counts(docs(s, d), stop=text.STOP_WORDS)))
    return (cells, *text.nmf(cells, 3))


def talk_topics(s, d) -> DataFrame:
    """The topics of the corpus in the turns of conversations."""
    turns = S.table(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return text.nmf_transform(text.counts(turns).withColumnRenamed("n", "weight"), topics(s, d)[2])


query("N4_nmf_topics", lambda s, d: text.topic_terms(topics(s, d)[2].select("term", F.posexplode("h").alias("topic", "weight")), 10), None)
query("N5_nmf_transform", talk_topics, None)

BATCHES = f"SELECT *, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 1000) AS INTEGER) AS batch FROM events"


def batches(s, d) -> DataFrame:
    return drift.batches(S.table(s, d, "events"), 1000, "ts", "event_id")


query("S1_batches", lambda s, d: batches(s, d).select("event_id", "batch"), f"SELECT event_id, batch FROM ({BATCHES})")
EDGES = ", ".join(f"round(quantile_cont(value, {i / 10}), 9)" for i in range(11))
PSI = f"""WITH b AS ({BATCHES}), q AS (SELECT list_sort(list_distinct([{EDGES}])) AS e FROM b WHERE batch = 0), i AS (SELECT e[2:len(e) - 1] AS inner_, len(e) AS n FROM q),
s AS (SELECT batch, CAST(len(list_filter(inner_, lambda x: x <= round(value, 9))) AS INTEGER) AS bin FROM b, i), g AS (SELECT batch, bin FROM (SELECT DISTINCT batch FROM s), i, unnest(range(CAST(n AS BIGINT) - 1)) AS r(bin)),
c AS (SELECT batch, bin, count(*) AS c FROM s GROUP BY 1, 2), f AS (SELECT g.batch, bin, greatest(coalesce(c, 0) / CAST(sum(coalesce(c, 0)) OVER (PARTITION BY g.batch) AS DOUBLE), 1e-6) AS p FROM g LEFT JOIN c USING (batch, bin))
SELECT a.batch, sum((a.p - e.p) * ln(a.p / e.p)) AS psi FROM f a JOIN f e ON e.bin = a.bin AND e.batch = 0 GROUP BY 1"""


def psi(s, d) -> DataFrame:
    b = batches(s, d)
    return drift.population_stability(b.where("batch = 0"), b, "value")


query("S2_psi_by_batch", lambda s, d: rounded(psi(s, d)), rounded_sql(PSI, ["psi"]))
query("S4_drift_points", lambda s, d: drift.drift_points(psi(s, d), 0.01), f"SELECT batch FROM ({PSI}) WHERE psi > 0.01")
def flat_batches(s, d) -> DataFrame:
    """Events as points in batches of 5000: (id, batch, x)."""
    return drift.batches(S.table(s, d, "events"), 5000, "ts", "event_id").select(F.col("event_id").alias("id"), "batch", F.array(F.col("value"), F.lit(1.0)).alias("x"))


query("C8_mini_batch_kmeans", lambda s, d: drift.mini_batch_kmeans(settle(flat_batches(s, d)), 3)[1], None)
query("S5_streaming_agreement", lambda s, d: drift.streaming_agreement(settle(flat_batches(s, d)), 3), None)
query(
    "S6_distinct_events",
    lambda s, d: live.distinct_events(S.table(s, d, "events"), ["user_id", "event_type"]),
    "SELECT DISTINCT user_id, event_type FROM events",
)


def stream_scores(s, d) -> DataFrame:
    """The events read as a stream, each put to the nearest of three given levels, and what the stream has written."""
    out, schema = scratch(s, "stream"), S.table(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    score = lambda e: cluster.assign(e.select(F.col("event_id").alias("id"), F.array("value").alias("x")), [[10.0], [200.0], [600.0]])
    live.score_stream(stream, score, f"{out}/rows", f"{out}/state").awaitTermination()
    return s.read.parquet(f"{out}/rows")


LEVELS = ", ".join(f"round((value - {v}) ** 2, 9)" for v in ("10e0", "200e0", "600e0"))
query(
    "S7_stream_scores",
    lambda s, d: rounded(stream_scores(s, d), 4),
    f"SELECT event_id AS id, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS label, round(list_min(ds), 4) AS d2 FROM (SELECT event_id, [{LEVELS}] AS ds FROM events)",
)
query("S3_monitor", lambda s, d: rounded(drift.monitor(drift.batches(S.table(s, d, "events"), 5000, "ts", "event_id").select(F.col("event_id").alias("id"), "batch", F.array(F.col("value"), F.lit(1.0)).alias("x")), 3), 4), None)
WINDOWED = "SELECT {0} AS start, event_type, count(*) AS n, round(sum(CAST(round(value * 100) AS BIGINT)) / 100e0, 6) AS total FROM events{1} GROUP BY 1, 2"
query("S6_tumbling_windows", lambda s, d: rounded(live.tumbling(S.table(s, d, "events"), "1 day")), WINDOWED.format("date_trunc('day', ts)", ""))
query(
    "S6_sliding_windows",
    lambda s, d: rounded(live.tumbling(S.table(s, d, "events"), "2 days", "1 day")),
    WINDOWED.format("date_trunc('day', ts) - k * INTERVAL 1 DAY", ", range(2) AS r(k)").replace("GROUP BY 1, 2", "GROUP BY 1, 2"),
)
query(
    "S6_session_windows",
    lambda s, d: live.sessions(S.table(s, d, "events"), 6 * 3600),
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)


def runs(s, d) -> DataFrame:
    """Four labellings of the embeddings: the given one, and three coarser ones of it and the id."""
    m = S.matrix(s, d)
    of = lambda r, e: m.select(F.lit(r).alias("run"), "id", e.cast("int").alias("label"))
    return of(0, F.col("label")).union(of(1, F.col("label") % 5)).union(of(2, F.col("id") % 4)).union(of(3, F.floor(F.col("label") / 3)))


RUNS = " UNION ALL ".join(f"SELECT {r} AS run, id, CAST({e} AS INTEGER) AS label FROM ({MATRIX})" for r, e in enumerate(("label", "label % 5", "id % 4", "floor(label / 3)")))
query(
    "B2_pairwise_ami",
    lambda s, d: rounded(stability.pairwise_ami(runs(s, d))),
    f"""WITH u AS ({RUNS}), c AS (SELECT x.run AS ra, y.run AS rb, x.label AS a, y.label AS b, count(*) AS n FROM u x JOIN u y ON x.id = y.id AND x.run < y.run GROUP BY 1, 2, 3, 4),
w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY ra, rb) AS BIGINT) AS t, CAST(sum(n) OVER (PARTITION BY ra, rb, a) AS BIGINT) AS ai, CAST(sum(n) OVER (PARTITION BY ra, rb, b) AS BIGINT) AS bj FROM c),
mi AS (SELECT ra, rb, sum(n / CAST(t AS DOUBLE) * ln(CAST(t AS DOUBLE) * n / (CAST(ai AS DOUBLE) * bj))) AS mi FROM w GROUP BY 1, 2),
a AS (SELECT DISTINCT ra, rb, a, ai, t FROM w), b AS (SELECT DISTINCT ra, rb, b, bj FROM w),
h AS (SELECT ra, rb, (ha + hb) / 2 AS h FROM (SELECT ra, rb, sum(-ai / CAST(t AS DOUBLE) * ln(ai / CAST(t AS DOUBLE))) AS ha FROM a GROUP BY 1, 2) JOIN (SELECT b.ra, b.rb, sum(-bj / CAST(t AS DOUBLE) * ln(bj / CAST(t AS DOUBLE))) AS hb FROM b JOIN (SELECT DISTINCT ra, rb, t FROM a) USING (ra, rb) GROUP BY 1, 2) USING (ra, rb)),
e AS (SELECT ra, rb, sum(k / CAST(t AS DOUBLE) * ln(CAST(t AS DOUBLE) * k / (CAST(ai AS DOUBLE) * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(t - ai + 1) + lgamma(t - bj + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(ai - k + 1) - lgamma(bj - k + 1) - lgamma(t - ai - bj + k + 1))) AS emi
  FROM a JOIN b USING (ra, rb), unnest(range(greatest(1, ai + bj - t), least(ai, bj) + 1)) AS r(k) GROUP BY 1, 2),
x AS (SELECT (mi - emi) / (h - emi) AS ami FROM mi JOIN h USING (ra, rb) JOIN e USING (ra, rb))
SELECT round(avg(ami), 6) AS mean_ami, round(stddev_pop(ami), 6) AS std_ami, count(ami) AS n_pairs, (SELECT round(avg(k), 6) FROM (SELECT count(DISTINCT label) AS k FROM u GROUP BY run)) AS mean_n_clusters FROM x""",
)
SHARES = f"SELECT a.id AS i, b.id AS j, count(*) FILTER (a.label = b.label) / CAST(count(*) AS DOUBLE) AS share FROM ({RUNS}) a JOIN ({RUNS}) b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2"
query("B7_coassociation", lambda s, d: rounded(stability.coassociation(runs(s, d))), f"SELECT i, j, round(share, 6) AS share FROM ({SHARES})")
query(
    "B9_intra_cluster_stability",
    lambda s, d: rounded(stability.intra_cluster_stability(runs(s, d), runs(s, d).where("run = 0").select("id", "label"))),
    f"SELECT round(avg(share), 6) AS stability FROM ({SHARES}) JOIN ({MATRIX}) a ON a.id = i JOIN ({MATRIX}) b ON b.id = j WHERE a.label = b.label",
)
query("B3_subsample_stability", lambda s, d: stability.subsample_stability(flat(s, d), lambda x, seed: cluster.lloyd(x, 3)), None)
query(
    "B1_repeated_runs",
    lambda s, d: stability.repeated_runs(flat(s, d), lambda x, seed: cluster.lloyd(x, 2 + seed, 2), 3),
    " UNION ALL ".join(f"SELECT {r} AS run, id, label FROM ({lloyd_sql(2 + r, 2)})" for r in range(3)),
)
query("B4_scaling_sensitivity", lambda s, d: stability.scaling_sensitivity(S.customer_features(s, d), COLS, lambda x: cluster.lloyd(x, 4)), None)
query("B5_outlier_sensitivity", lambda s, d: stability.outlier_sensitivity(flat(s, d), lambda x: cluster.lloyd(x, 4)), None)


def nation_runs(s, d) -> DataFrame:
    """Labellings of the nations, one for each market segment: how many customers it has there, by thirds."""
    n = S.table(s, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("c_mktsegment").alias("run"), F.col("c_nationkey").cast("long").alias("id"), (F.col("n") % 3).cast("int").alias("label"))


query("B8_consensus", lambda s, d: stability.consensus(nation_runs(s, d), 3), None)

SHARE = "SELECT c_nationkey AS component, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS weight FROM customer GROUP BY 1"


def shares(s, d) -> DataFrame:
    n = S.table(s, d, "customer").groupBy(F.col("c_nationkey").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("component", (F.col("n") / F.col("t")).alias("weight"))


query("M2_effective_components", lambda s, d: mixture.effective_components(shares(s, d), 0.04), f"SELECT count(*) FILTER (weight > 0.04e0) AS effective FROM ({SHARE})")
query("M3_weight_table", lambda s, d: rounded(mixture.weight_table(shares(s, d))), f"SELECT component, round(weight, 6) AS weight, round(sum(weight) OVER (ORDER BY weight DESC, component ROWS UNBOUNDED PRECEDING), 6) AS cumulative_weight FROM ({SHARE})")
KINDS = ["click", "view", "purchase", "error", "signup"]
PARTS = ", ".join(f"count(*) FILTER (event_type = '{k}') / CAST(count(*) AS DOUBLE)" for k in KINDS)
query(
    "M4_assignment_uncertainty",
    lambda s, d: rounded(mixture.uncertainty(S.table(s, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.array(*(F.sum((F.col("event_type") == k).cast("long")) / F.count(F.lit(1)) for k in KINDS)).alias("p")))),
    f"""WITH p AS (SELECT user_id AS id, [{PARTS}] AS p FROM events GROUP BY 1)
SELECT id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS dominant_component, round(list_max(p), 6) AS max_responsibility, round(-list_sum(list_transform(p, lambda v: v * ln(greatest(least(v, 1e0), 1e-12)))), 6) AS entropy FROM p""",
)
query("M1_dirichlet_process", lambda s, d: mixture.dirichlet_process(flat(s, d))[1], None)
query("M5_dirichlet_labels", lambda s, d: mixture.dirichlet_process(flat(s, d))[0].select("id", "label"), None)
query("M1_dirichlet_spherical", lambda s, d: mixture.dirichlet_process(flat(s, d), covariance="spherical")[1], None)
query("M6_prior_sensitivity", lambda s, d: mixture.prior_sensitivity(flat(s, d), [0.01, 1.0]), None)

GRAPH = f"WITH m AS ({MATRIX}), {NEAR.format(k=8)}, g AS (SELECT id AS src, j AS dst FROM near UNION SELECT j, id FROM near)"
query("R1_knn_graph", lambda s, d: graph.knn_graph(S.matrix(s, d), 8), GRAPH + " SELECT src, dst, 1e0 AS w FROM g")
query(
    "R2_modularity",
    lambda s, d: rounded(graph.modularity(graph.knn_graph(S.matrix(s, d), 8), S.matrix(s, d).select("id", "label"))),
    GRAPH + ", p AS (SELECT a.label, count(*) AS deg, count(*) FILTER (a.label = b.label) AS i FROM g JOIN m a ON a.id = src JOIN m b ON b.id = dst GROUP BY 1) SELECT round(sum(i / CAST(t AS DOUBLE) - (deg / CAST(t AS DOUBLE)) ** 2), 6) AS modularity FROM p, (SELECT count(*) AS t FROM g)",
)
STRUCTURE = GRAPH + """, deg AS (SELECT src AS id, count(*) AS degree FROM g GROUP BY 1), tri AS (SELECT a.src AS id, count(*) AS tri FROM g a JOIN g b ON a.dst = b.src JOIN g c ON c.src = b.dst AND c.dst = a.src GROUP BY 1),
near2 AS (SELECT src AS id, sum(degree) AS near FROM g JOIN deg ON deg.id = dst GROUP BY 1)
SELECT m.id, CAST(coalesce(degree, 0) AS DOUBLE) AS degree, CASE WHEN degree * (degree - 1) > 0 THEN round(coalesce(tri, 0) / CAST(degree * (degree - 1) AS DOUBLE), 6) ELSE 0e0 END AS clustering_coefficient, CASE WHEN degree > 0 THEN round(near / CAST(degree AS DOUBLE), 6) ELSE 0e0 END AS avg_neighbor_degree
FROM m LEFT JOIN deg USING (id) LEFT JOIN tri USING (id) LEFT JOIN near2 USING (id)"""
query("R6_node_structural_features", lambda s, d: rounded(graph.structural_features(graph.knn_graph(S.matrix(s, d), 8), S.matrix(s, d))), STRUCTURE)
query("R8_degree_ranking", lambda s, d: graph.structural_features(graph.knn_graph(S.matrix(s, d), 8), S.matrix(s, d)).orderBy(F.desc("degree"), "id").limit(20).select("id", "degree"), f"SELECT id, degree FROM ({STRUCTURE}) ORDER BY degree DESC, id LIMIT 20")
query("R7_graph_anomaly_scores", lambda s, d: graph.graph_anomaly_scores(graph.knn_graph(S.matrix(s, d), 8), S.matrix(s, d)), None)
query("D4_isomap", lambda s, d: graph.isomap(flat(s, d)), None)
query("D7_laplacian_eigenmaps", lambda s, d: graph.spectral_embedding(graph.knn_graph(S.matrix(s, d), 8)), None)
query("R3_communities", lambda s, d: graph.detect_communities(graph.knn_graph(S.matrix(s, d), 8), 3), None)

DAYS = f"SELECT series_id, list(v ORDER BY pos) AS values FROM ({DAILY}) GROUP BY 1"


def days(s, d) -> DataFrame:
    return series.gather(S.daily_series(s, d))


WARP = f"""WITH RECURSIVE s AS ({DAYS}), p AS (SELECT a.series_id AS a, b.series_id AS b, a.values AS x, b.values AS y FROM s a JOIN s b ON a.series_id < b.series_id),
w(a, b, x, y, i, r) AS (SELECT a, b, x, y, 0, [0e0] || list_transform(y, lambda v: CAST('inf' AS DOUBLE)) FROM p UNION ALL
  SELECT a, b, x, y, i + 1, list_reduce(range(1, len(y) + 1), lambda acc, j: acc || [(x[i + 1] - y[j]) ** 2 + least(r[j + 1], acc[len(acc)], r[j])], [CAST('inf' AS DOUBLE)]) FROM w WHERE i < len(x))
SELECT a, b, round(sqrt(r[len(r)]), 6) AS d FROM w WHERE i = len(x)"""
BANDED = WARP.replace("(x[i + 1] - y[j]) ** 2", "CASE WHEN abs(j - 1 - round_even(i * len(y) / len(x), 0)) <= 8 THEN (x[i + 1] - y[j]) ** 2 ELSE CAST('inf' AS DOUBLE) END")
query("X2_dtw_matrix", lambda s, d: rounded(series.dtw_pairs(days(s, d), 8)), BANDED)
query("X3_series_clusters", lambda s, d: series.cluster_series(days(s, d), 2, 8), None)
query(
    "X1_dtw_distance",
    lambda s, d: rounded((lambda t: t.toDF("a", "va").join(t.toDF("b", "vb"), F.col("a") < F.col("b")).select("a", "b", series.dtw_expression(F.col("va"), F.col("vb")).alias("d")))(days(s, d))),
    WARP,
)
query(
    "X9_znorm",
    lambda s, d: rounded(days(s, d).select("series_id", F.posexplode(V.z_normalised(F.col("values"))).alias("pos", "z"))),
    f"SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS INTEGER) AS pos, round((v - avg(v) OVER (PARTITION BY series_id)) / stddev_pop(v) OVER (PARTITION BY series_id), 6) AS z FROM ({DAILY})",
)
query("X10_euclid_pairs", lambda s, d: rounded(series.euclid_pairs(days(s, d))), f"SELECT a.series_id AS a, b.series_id AS b, round(list_distance(a.values, b.values), 6) AS d FROM ({DAYS}) a JOIN ({DAYS}) b ON a.series_id < b.series_id")


def profile(s, d) -> DataFrame:
    return series.matrix_profile(S.hourly_series(s, d), 8)


PROFILE = f"""WITH h AS ({HOURLY}), w AS (SELECT pos, list(v) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM h QUALIFY len(w) = 8),
st AS (SELECT pos, w[i] AS v, i FROM w, unnest(range(1, 9)) AS r(i)), z AS (SELECT pos, list((v - m) / coalesce(nullif(sd, 0), 1) ORDER BY i) AS z FROM (SELECT *, avg(v) OVER (PARTITION BY pos) AS m, stddev_pop(v) OVER (PARTITION BY pos) AS sd FROM st) GROUP BY 1),
d AS (SELECT a.pos, b.pos AS j, round(list_distance(a.z, b.z), 9) AS d FROM z a JOIN z b ON abs(a.pos - b.pos) > 4)
SELECT pos, min(d) AS d, arg_min(j, (d, j)) AS nearest FROM d GROUP BY 1"""
query("X4_matrix_profile", lambda s, d: rounded(profile(s, d)), rounded_sql(PROFILE, ["d"]))


def greedy_sql(largest: bool, k: int = 3, window: int = 8) -> str:
    """The same picks one after another over the profile."""
    order, out = "d DESC, pos" if largest else "d, pos", f"WITH prof AS ({PROFILE})"
    for r in range(1, k + 1):
        clear = " AND ".join([f"abs(pos - (SELECT pos FROM p{q})) >= {window}" for q in range(1, r)] or ["true"])
        out += f", p{r} AS (SELECT {r} AS rank, pos, d FROM prof WHERE {clear} ORDER BY {order} LIMIT 1)"
    return out + " " + " UNION ALL ".join(f"SELECT rank, pos, round(d, 6) AS d FROM p{r}" for r in range(1, k + 1))


query("X5_discords", lambda s, d: rounded(series.greedy(settle(profile(s, d)), 8, 3)), greedy_sql(True))
query("X5_motifs", lambda s, d: rounded(series.greedy(settle(profile(s, d)), 8, 3, largest=False)), greedy_sql(False))


def near_first(s, d) -> DataFrame:
    """Each series' distance to the first six days of the series of least name."""
    t = days(s, d)
    one = t.orderBy("series_id").limit(1).select(F.slice("values", 1, 6).alias("q"))
    return t.crossJoin(F.broadcast(one)).select(F.col("series_id").alias("id"), series.subsequence_distance(F.col("q"), F.col("values"), 6).alias("d"))


STRETCH = f"""WITH s AS ({DAYS}), t AS (SELECT series_id, k, i, values[k + i - 1] AS v FROM s, unnest(range(1, len(values) - 4)) AS r(k), unnest(range(1, 7)) AS q(i)),
z AS (SELECT series_id, k, list((v - m) / coalesce(nullif(sd, 0), 1) ORDER BY i) AS z FROM (SELECT *, avg(v) OVER (PARTITION BY series_id, k) AS m, stddev_pop(v) OVER (PARTITION BY series_id, k) AS sd FROM t) GROUP BY 1, 2),
d AS (SELECT b.series_id AS id, min(list_distance(a.z, b.z)) AS d FROM z a, z b WHERE a.k = 1 AND a.series_id = (SELECT min(series_id) FROM s) GROUP BY 1)"""
query("X6_subsequence_distance", lambda s, d: rounded(near_first(s, d)), STRETCH + " SELECT id, round(d, 6) AS d FROM d")
GAP = """, n AS (SELECT id, d, row_number() OVER w AS n, sum(d) OVER w AS s, sum(d * d) OVER w AS q, count(*) OVER () AS t, sum(d) OVER () AS ts, sum(d * d) OVER () AS tq, lead(d) OVER w AS nx FROM (SELECT id, round(d, 6) AS d FROM d) WINDOW w AS (ORDER BY d, id)),
g AS (SELECT *, round(((ts - s) / (t - n) - sqrt(greatest((tq - q) / (t - n) - ((ts - s) / (t - n)) ** 2, 0))) - (s / n + sqrt(greatest(q / n - (s / n) ** 2, 0))), 9) AS gap FROM n WHERE n >= 1 AND t - n >= 1)
SELECT max(gap) AS gap, round(arg_max((d + nx) / 2, (gap, -n)), 6) AS threshold FROM g"""
query("X7_shapelet_gap", lambda s, d: rounded(series.shapelet_gap(rounded(near_first(s, d))), 6), rounded_sql(STRETCH + GAP, ["gap"]))
query("X11_split", lambda s, d: near_first(s, d).select("id", (F.round("d", 6) <= 1.5).alias("near")), STRETCH + " SELECT id, round(d, 6) <= 1.5 AS near FROM d")
query("X8_shapelets", lambda s, d: rounded(series.pick_shapelets(series.discover_shapelets(days(s, d), 6), 6, 5)), None)

CELLS_I = "SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"
query("I1_sparse_interactions", lambda s, d: recsys.cells(S.interactions(s, d)), CELLS_I)
query(
    "I4_similar_items",
    lambda s, d: rounded(recsys.similar_items(S.matrix(s, d), 7)),
    f"""WITH m AS ({MATRIX}), r AS (SELECT a.id, list_cosine_similarity(a.x, b.x) AS c FROM m a, m b WHERE b.id = 7 AND a.id <> 7 ORDER BY round(c, 9) DESC, a.id LIMIT 5)
SELECT id, round(c, 6) AS similarity, CAST(row_number() OVER (ORDER BY round(c, 9) DESC, id) AS INTEGER) AS rank FROM r""",
)
query("I7_l2_normalise", lambda s, d: rounded(S.matrix(s, d).select("id", F.posexplode(V.unit(F.col("x"))).alias("i", "u"))), f"SELECT id, CAST(i - 1 AS INTEGER) AS i, round(x[i] / sqrt(list_dot_product(x, x)), 6) + 0e0 AS u FROM ({MATRIX}), unnest(range(1, 65)) AS r(i)")


def factors(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every embedding as a user and as an item; what a customer of the same number bought is seen."""
    m = S.matrix(s, d)
    users, items = m.select(F.col("id").alias("user_id"), F.col("x").alias("u")), m.select(F.col("id").alias("item_id"), F.col("x").alias("v"))
    return users, items, S.interactions(s, d)


query(
    "I6_recommend",
    lambda s, d: rounded(recsys.recommend(*factors(s, d), 5)),
    f"""WITH m AS ({MATRIX}), c AS (SELECT a.id AS user_id, b.id AS item_id, list_dot_product(a.x, b.x) AS score FROM m a, m b WHERE NOT EXISTS (SELECT 1 FROM ({CELLS_I}) WHERE user_id = a.id AND item_id = b.id))
SELECT user_id, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 5""",
)


def explained(s, d) -> DataFrame:
    """(direction, share): what each direction of the factors explains of the interactions."""
    cells = settle(recsys.cells(S.interactions(s, d)))
    shares = recsys.explained_variance(settle(recsys.svd_factors(cells, 2)[0]), cells)
    return s.createDataFrame(list(enumerate(shares)), "direction int, share double")


query("I2_svd", lambda s, d: recsys.svd_factors(recsys.cells(S.interactions(s, d)), 2)[1], None)
query("D6_explained_variance", explained, None)
query("I3_nmf_factors", lambda s, d: text.nmf(recsys.cells(S.interactions(s, d)), 3, row="user_id", column="item_id", value="value")[1], None)
UNIT = f"SELECT id, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS x FROM ({MATRIX})"
query("I5_item_groups", lambda s, d: recsys.item_groups(S.matrix(s, d), 4, lambda x, k: cluster.lloyd(x, k, 2)), lloyd_sql(4, 2, UNIT, 64))
query(
    "L3_best_run",
    lambda s, d: rounded(S.scores(s, d).groupBy(F.col("event_type").alias("name")).agg((F.sum(S.cents(F.col("score"))) / 100.0 / F.count(F.lit(1))).alias("metric")).orderBy(F.desc(F.round("metric", 9)), "name").limit(1)),
    f"SELECT event_type AS name, round(sum(CAST(round(score * 100) AS BIGINT)) / 100e0 / count(*), 6) AS metric FROM ({SCORES}) GROUP BY 1 ORDER BY metric DESC, name LIMIT 1",
)



def n_rows(s, d, name: str) -> int:
    return S.table(s, d, name).count()


def nation_sizes(s, d) -> list[int]:
    """The suppliers of each nation, as sizes of blocks."""
    return [r["count"] for r in S.table(s, d, "supplier").groupBy("s_nationkey").count().orderBy("s_nationkey").collect()]


# generated tables as large as the given ones
query("G3_corpus", lambda s, d: generators.corpus(s, per_topic=-(-n_rows(s, d, "documents") // 4)), None)
query("G4_generated_interactions", lambda s, d: generators.user_items(s, n_rows(s, d, "customer"), n_rows(s, d, "supplier")), None)
query("G5_block_graph", lambda s, d: generators.block_graph(s, nation_sizes(s, d), 0.4, 0.03)[0], None)
query("K7_persona_cards", lambda s, d: s.createDataFrame([(explain.persona_cards(S.customer_features(s, d), COLS, "segment"),)], "cards string"), None)
