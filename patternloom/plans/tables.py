"""Queries over features, scaling, evaluation, explanation, cut-offs and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.operators import anomaly, cluster, cuts, deep, evaluation, explain, hierarchy, models, prep, reduce
from patternloom.operators.iterate import scratch, settle
from patternloom.plans.registry import FEATURES, HOURS, MATRIX, RFM, SCORES, query, rounded, rounded_sql
from patternloom.sources import features as S

COLS = S.CUSTOMER_FEATURES
CENTRES = [[30.0, 10.0], [200.0, 5.0], [600.0, 1.0]]
query("G1_customer_rfm_features", lambda s, d: rounded(S.customer_features(s, d)), rounded_sql(FEATURES, COLS))
query("G2_event_sensor_features", lambda s, d: rounded(S.sensor_features(s, d)), rounded_sql(HOURS, ["value_mean", "value_max", "error_ratio"]))
query("G4_interactions_long", S.interactions, "SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity) AS interaction_strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")


def scaled_sql(centre: str, spread: str) -> str:
    cols = ", ".join(f"({c} - {centre.format(c)}) / coalesce(nullif({spread.format(c)}, 0), 1) AS {c}" for c in COLS)
    return rounded_sql(f"SELECT row_id, segment, {cols} FROM ({FEATURES})", COLS, 4)


query("P1_scale_standard", lambda s, d: rounded(prep.scale(S.customer_features(s, d), COLS), 4), scaled_sql("avg({0}) OVER ()", "stddev_pop({0}) OVER ()"))
query(
    "P2_scale_robust",
    lambda s, d: rounded(prep.scale(S.customer_features(s, d), COLS, "robust"), 4),
    scaled_sql("quantile_cont({0}, 0.5) OVER ()", "(quantile_cont({0}, 0.75) OVER () - quantile_cont({0}, 0.25) OVER ())"),
)

PAIRS = "p AS (SELECT a.id, a.label, b.label AS m, avg(list_distance(a.x, b.x)) AS d FROM m a JOIN m b ON a.id <> b.id GROUP BY 1, 2, 3)"
SILHOUETTE = f"""WITH m AS ({MATRIX}), {PAIRS},
s AS (SELECT id, label, max(d) FILTER (m = label) AS a, min(d) FILTER (m <> label) AS b FROM p GROUP BY 1, 2)
SELECT round(avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0e0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s"""
SIZED = f"WITH m AS ({MATRIX}), k AS (SELECT label, count(*) AS size FROM m GROUP BY 1), cc AS (SELECT label, i, avg(x[i]) AS v FROM m, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2), c AS (SELECT label, list(v ORDER BY i) AS centre FROM cc GROUP BY 1)"
BOULDIN = f"""{SIZED}, s AS (SELECT m.label, any_value(centre) AS centre, avg(list_distance(x, centre)) AS s FROM m JOIN c USING (label) GROUP BY 1),
w AS (SELECT a.label, max((a.s + b.s) / list_distance(a.centre, b.centre)) AS r FROM s a JOIN s b ON a.label <> b.label GROUP BY 1)
SELECT round(avg(r), 6) AS davies_bouldin FROM w"""
HARABASZ = f"""{SIZED}, g AS (SELECT list(v ORDER BY i) AS mid FROM (SELECT i, avg(x[i]) AS v FROM m, unnest(range(1, 65)) AS r(i) GROUP BY 1)),
b AS (SELECT sum(size * list_distance(centre, mid) ** 2) AS b, sum(size) AS n, count(*) AS k FROM c JOIN k USING (label), g),
w AS (SELECT sum(list_distance(x, centre) ** 2) AS w FROM m JOIN c USING (label))
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w"""
query("E2_silhouette_euclidean", lambda s, d: rounded(evaluation.silhouette(S.matrix(s, d))), SILHOUETTE)
query("E3_davies_bouldin", lambda s, d: rounded(evaluation.davies_bouldin(S.matrix(s, d))), BOULDIN)
query("E4_calinski_harabasz", lambda s, d: rounded(evaluation.calinski_harabasz(S.matrix(s, d))), HARABASZ)
query(
    "E1_evaluate_clustering",
    lambda s, d: rounded(evaluation.evaluate(S.matrix(s, d))),
    f"SELECT (SELECT count(DISTINCT label) FROM ({MATRIX})) AS n_clusters, ({SILHOUETTE}) AS silhouette, ({BOULDIN}) AS davies_bouldin, ({HARABASZ}) AS calinski_harabasz",
)
CELLS = "SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2"
query(
    "E6_adjusted_rand",
    lambda s, d: rounded(evaluation.adjusted_rand(S.table(s, d, "documents"), "lang", "source"), 9),
    f"""WITH c AS ({CELLS}), t AS (SELECT sum(n * (n - 1) / 2e0) AS ij, sum(n) AS n FROM c),
i AS (SELECT sum(m * (m - 1) / 2e0) AS i FROM (SELECT sum(n) AS m FROM c GROUP BY a)), j AS (SELECT sum(m * (m - 1) / 2e0) AS j FROM (SELECT sum(n) AS m FROM c GROUP BY b))
SELECT round((ij - i * j / (n * (n - 1) / 2e0)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2e0)), 9) AS ari FROM t, i, j""",
)
AMI = """t AS (SELECT CAST(sum(n) AS BIGINT) AS t FROM c), ra AS (SELECT a, CAST(sum(n) AS BIGINT) AS ai FROM c GROUP BY 1), rb AS (SELECT b, CAST(sum(n) AS BIGINT) AS bj FROM c GROUP BY 1),
mi AS (SELECT sum(n / CAST(t AS DOUBLE) * ln(CAST(t AS DOUBLE) * n / (CAST(ai AS DOUBLE) * bj))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), t),
h AS (SELECT (SELECT sum(-ai / CAST(t AS DOUBLE) * ln(ai / CAST(t AS DOUBLE))) FROM ra, t) AS ha, (SELECT sum(-bj / CAST(t AS DOUBLE) * ln(bj / CAST(t AS DOUBLE))) FROM rb, t) AS hb),
e AS (SELECT sum(k / CAST(t AS DOUBLE) * ln(CAST(t AS DOUBLE) * k / (CAST(ai AS DOUBLE) * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(t - ai + 1) + lgamma(t - bj + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(ai - k + 1) - lgamma(bj - k + 1) - lgamma(t - ai - bj + k + 1))) AS emi
  FROM ra, rb, t, unnest(range(greatest(1, ai + bj - t), least(ai, bj) + 1)) AS r(k))
SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM mi, h, e"""
query(
    "E7_adjusted_mutual_info",
    lambda s, d: rounded(evaluation.adjusted_mutual_information(evaluation.contingency(S.table(s, d, "documents"), "lang", "source"))),
    f"WITH c AS ({CELLS}), {AMI}",
)
query("E8_precision_at_k", lambda s, d: rounded(evaluation.precision_at_k(S.scores(s, d), 120)), f"SELECT round(avg(CAST(is_anomaly AS DOUBLE)), 6) AS precision FROM (SELECT * FROM ({SCORES}) ORDER BY score DESC, id LIMIT 120)")
query(
    "E9_crosstab_purity",
    lambda s, d: rounded(evaluation.purity(S.table(s, d, "customer"), "c_nationkey", "c_mktsegment")),
    """SELECT cluster, dominant, n, round(share, 6) AS purity FROM (SELECT c_nationkey AS cluster, c_mktsegment AS dominant, CAST(sum(count(*)) OVER (PARTITION BY c_nationkey) AS BIGINT) AS n,
count(*) / CAST(sum(count(*)) OVER (PARTITION BY c_nationkey) AS DOUBLE) AS share, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r = 1""",
)

query(
    "K1_cluster_profile",
    lambda s, d: rounded(explain.profile(S.customer_features(s, d), COLS, "segment"), 4),
    rounded_sql(f"SELECT segment AS cluster, {', '.join(f'avg({c}) AS {c}' for c in COLS)}, count(*) AS cluster_size FROM ({FEATURES}) GROUP BY 1", COLS, 4),
)
LONG = " UNION ALL ".join(f"SELECT row_id, segment, '{c}' AS feature, {c} AS v FROM f" for c in COLS)
DISTINCT = f"""WITH f AS ({FEATURES}), l AS ({LONG}), o AS (SELECT feature, avg(v) AS om, stddev_pop(v) AS sd FROM l GROUP BY 1),
g AS (SELECT segment AS cluster, feature, avg(v) AS cluster_mean, any_value(om) AS overall_mean, (avg(v) - any_value(om)) / coalesce(nullif(any_value(sd), 0), 1) AS deviation FROM l JOIN o USING (feature) GROUP BY 1, 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(abs(deviation), 9) DESC, feature) AS INTEGER) AS rank FROM g)"""
query(
    "K3_distinctive_features",
    lambda s, d: rounded(explain.distinctive_features(S.customer_features(s, d), COLS, "segment"), 4),
    DISTINCT + " SELECT cluster, rank, feature, round(cluster_mean, 4) AS cluster_mean, round(overall_mean, 4) AS overall_mean, round(deviation, 4) AS deviation, CASE WHEN deviation > 0 THEN 'high' ELSE 'low' END AS direction FROM k WHERE rank <= 3",
)
query(
    "K4_name_clusters",
    lambda s, d: explain.name_clusters(S.customer_features(s, d), COLS, "segment"),
    DISTINCT + " SELECT cluster, string_agg(CASE WHEN deviation > 0 THEN 'high ' ELSE 'low ' END || feature, ', ' ORDER BY rank) AS name FROM k WHERE rank <= 2 GROUP BY 1",
)
SCALED = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)" for c in COLS)
CENTRED = f"""WITH f AS ({FEATURES}), z AS (SELECT row_id AS id, segment AS cluster, [{SCALED}] AS x FROM f),
c AS (SELECT cluster AS c, [{', '.join(f'avg(x[{i + 1}])' for i in range(len(COLS)))}] AS centre FROM z GROUP BY 1)"""
OWN = ", ".join(f"round({c}, 4) AS {c}" for c in COLS)
query(
    "K5_exemplars",
    lambda s, d: rounded(explain.exemplars(S.customer_features(s, d), COLS, "segment"), 4),
    CENTRED + f""", e AS (SELECT id, cluster, list_distance(x, centre) AS d, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(list_distance(x, centre), 9), id) AS INTEGER) AS rank FROM z JOIN c ON cluster = c)
SELECT id, cluster, round(d, 4) AS distance_to_centre, rank, {OWN} FROM e JOIN f ON id = row_id WHERE rank <= 3""",
)
query(
    "K6_boundary_cases",
    lambda s, d: rounded(explain.boundary_cases(S.customer_features(s, d), COLS, "segment"), 4),
    CENTRED + f""", e AS (SELECT id, cluster, c, round(list_distance(x, centre), 9) AS d FROM z, c),
o AS (SELECT id, cluster, arg_min(c, (d, c)) FILTER (c <> cluster) AS nearest_other_cluster, min(d) FILTER (c <> cluster) - min(d) FILTER (c = cluster) AS margin FROM e GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY round(margin, 8), id) AS INTEGER) AS rank FROM o)
SELECT id, cluster, nearest_other_cluster, round(margin, 4) AS margin, rank, {OWN} FROM r JOIN f ON id = row_id WHERE rank <= 3""",
)
query("K2_surrogate_rules", lambda s, d: explain.surrogate_rules(S.customer_features(s, d), COLS, "segment")[1], None)

QUANTILE = f"SELECT quantile_cont(score, 0.95) AS threshold FROM ({SCORES})"
MAD = f"""WITH e AS ({SCORES}), m AS (SELECT median(score) AS m, stddev_pop(score) AS sd FROM e), a AS (SELECT median(abs(score - m)) AS mad FROM e, m)
SELECT m + 3e0 * CASE WHEN mad > 0 THEN 1.4826e0 * mad ELSE sd END AS threshold FROM m, a"""
KNEE = f"""WITH e AS (SELECT score, row_number() OVER (ORDER BY score, id) - 1 AS rn, min(score) OVER () AS lo, max(score) OVER () AS hi, count(*) OVER () AS n FROM ({SCORES}))
SELECT arg_max(score, (round(lo + (hi - lo) * rn / (n - 1) - score, 9), -rn)) AS threshold FROM e"""
OTSU = f"""WITH e AS ({SCORES}), f AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS n, (max(score) - min(score)) / 128 AS w FROM e),
h AS (SELECT CAST(least(floor((score - lo) / w), 127) AS INTEGER) AS bin, count(*) AS c FROM e, f GROUP BY 1),
b AS (SELECT r.bin, coalesce(c, 0) / CAST(n AS DOUBLE) AS p, lo + (r.bin + 0.5e0) * w AS mid, lo, w FROM range(128) AS r(bin) LEFT JOIN h ON h.bin = r.bin, f),
s AS (SELECT bin, lo, w, sum(p) OVER (ORDER BY bin) AS sp, sum(p * mid) OVER (ORDER BY bin) AS sm, sum(p * mid) OVER () AS st FROM b)
SELECT arg_max(lo + (bin + 1) * w, (round((st * sp - sm) ** 2 / (sp * (1 - sp)), 9), -bin)) AS threshold FROM s WHERE sp > 1e-12 AND sp < 1 - 1e-12"""
query("T1_quantile_threshold", lambda s, d: rounded(cuts.quantile_threshold(S.scores(s, d))), rounded_sql(QUANTILE, ["threshold"]))
query("T2_mad_threshold", lambda s, d: rounded(cuts.mad_threshold(S.scores(s, d))), rounded_sql(MAD, ["threshold"]))
query("T3_knee_threshold", lambda s, d: rounded(cuts.knee_threshold(S.scores(s, d))), rounded_sql(KNEE, ["threshold"]))
query("T4_otsu_threshold", lambda s, d: rounded(cuts.otsu_threshold(S.scores(s, d))), rounded_sql(OTSU, ["threshold"]))
ALL = " UNION ALL ".join(f"SELECT '{n}' AS strategy, threshold FROM ({q})" for n, q in (("quantile", QUANTILE), ("mad", MAD), ("knee", KNEE), ("otsu", OTSU)))
query(
    "T5_compare_thresholds",
    lambda s, d: rounded(cuts.compare_thresholds(S.scores(s, d))),
    f"SELECT strategy, round(threshold, 6) AS threshold, count(*) FILTER (score >= threshold) AS n_flagged, round(count(*) FILTER (score >= threshold) / CAST(count(*) AS DOUBLE), 6) AS flagged_fraction FROM ({ALL}), ({SCORES}) GROUP BY strategy, threshold",
)
query(
    "T7_choice",
    lambda s, d: rounded(cuts.choice(S.scores(s, d), cuts.quantile_threshold(S.scores(s, d)), "quantile")),
    f"SELECT 'quantile' AS strategy, round(threshold, 6) AS threshold, count(*) FILTER (score >= threshold) AS n_flagged, round(count(*) FILTER (score >= threshold) / CAST(count(*) AS DOUBLE), 6) AS flagged_fraction FROM ({QUANTILE}), ({SCORES}) GROUP BY threshold",
)
query(
    "T6_evaluate_threshold",
    lambda s, d: rounded(cuts.evaluate_threshold(S.scores(s, d), 250.0)),
    f"""WITH c AS (SELECT count(*) FILTER (score >= 250 AND is_anomaly) AS tp, count(*) FILTER (score >= 250) AS f, count(*) FILTER (is_anomaly) AS pos FROM ({SCORES})),
r AS (SELECT tp / CAST(nullif(f, 0) AS DOUBLE) AS p, tp / CAST(nullif(pos, 0) AS DOUBLE) AS r, f FROM c)
SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN p + r = 0 THEN 0e0 END, 6) AS f1, f AS n_flagged FROM r""",
)


def detectors(spark, d) -> DataFrame:
    """Three scores of each event: its size, its distance from the mean, its reciprocal."""
    return anomaly.zscore(S.scores(spark, d), "score").select("id", "score", F.round("z", 9).alias("z"), F.round(1 / (1 + F.col("score")), 9).alias("small"))


DETECTORS = f"SELECT id, score, round(abs(score - avg(score) OVER ()) / stddev_pop(score) OVER (), 9) AS z, round(1 / (1 + score), 9) AS small FROM ({SCORES})"
MEMBERS = ["score", "z", "small"]
query(
    "A8_mean_ensemble_corr",
    lambda s, d: rounded(anomaly.mean_ensemble(detectors(s, d), MEMBERS).agg(*(F.corr("ensemble", m).alias(f"corr_{m}") for m in MEMBERS))),
    rounded_sql(f"SELECT {', '.join(f'corr((score + z + small) / 3, {m}) AS corr_{m}' for m in MEMBERS)} FROM ({DETECTORS})", [f"corr_{m}" for m in MEMBERS]),
)
RANKS = ", ".join(f"(rank() OVER (ORDER BY {m}) + (count(*) OVER (PARTITION BY {m}) - 1) / 2e0) / count(*) OVER () AS r{i}" for i, m in enumerate(MEMBERS))
query(
    "A9_rank_ensemble",
    lambda s, d: rounded(anomaly.rank_ensemble(detectors(s, d), MEMBERS).select("id", "ensemble"), 9),
    f"SELECT id, round((r0 + r1 + r2) / 3, 9) AS ensemble FROM (SELECT id, {RANKS} FROM ({DETECTORS}))",
)
query("A10_review_table", lambda s, d: anomaly.review_table(S.scores(s, d), "score", "id"), f"SELECT * FROM ({SCORES}) ORDER BY score DESC, id LIMIT 10")
query("A11_zscore_baseline", lambda s, d: rounded(anomaly.zscore(S.scores(s, d), "score").select("id", "z")), f"SELECT id, round(abs(score - avg(score) OVER ()) / stddev_pop(score) OVER (), 6) AS z FROM ({SCORES})")
MAHALANOBIS = f"""SELECT row_id, sqrt(greatest(0, (sbb * (a - ma) ** 2 - 2 * sab * (a - ma) * (b - mb) + saa * (b - mb) ** 2) / (saa * sbb - sab * sab))) AS distance
FROM (SELECT row_id, avg_order_value AS a, balance AS b FROM ({FEATURES})), (SELECT avg(avg_order_value) AS ma, avg(balance) AS mb, var_pop(avg_order_value) AS saa, covar_pop(avg_order_value, balance) AS sab, var_pop(balance) AS sbb FROM ({FEATURES}))"""
query(
    "A5_mahalanobis_classical",
    lambda s, d: rounded(anomaly.mahalanobis_2d(S.customer_features(s, d), "avg_order_value", "balance").select("row_id", "distance")),
    rounded_sql(MAHALANOBIS, ["distance"]),
)
query("A5_robust_covariance", lambda s, d: anomaly.robust_distances(S.customer_features(s, d), COLS), None)
query("A5_robust_cov_csteps", lambda s, d: rounded(anomaly.robust_distances_2d(S.customer_features(s, d), "avg_order_value", "balance", "row_id").select("row_id", "distance")), None)
NEAR = "near AS (SELECT a.id, b.id AS j, list_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY round(list_distance(a.x, b.x), 9), b.id) AS rank FROM m a JOIN m b ON a.id <> b.id QUALIFY rank <= {k})"
query(
    "A4_lof",
    lambda s, d: rounded(anomaly.local_outlier_factor(S.matrix(s, d), 20)),
    f"""WITH m AS ({MATRIX}), {NEAR.format(k=20)}, kd AS (SELECT id AS j, max(d) AS kd FROM near GROUP BY 1), lrd AS (SELECT id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM near JOIN kd USING (j) GROUP BY 1)
SELECT near.id, round(avg(l.lrd) / any_value(o.lrd), 6) AS lof FROM near JOIN lrd l ON l.id = near.j JOIN lrd o ON o.id = near.id GROUP BY 1""",
)
query(
    "C7_knn_eps",
    lambda s, d: rounded(cluster.knn_eps(S.matrix(s, d))),
    f"WITH m AS ({MATRIX}), {NEAR.format(k=9)} SELECT round(quantile_cont(d, 0.85), 6) AS eps FROM (SELECT max(d) AS d FROM near GROUP BY id)",
)
query("A2_train_anomaly_model", lambda s, d: models.train_anomaly_model(S.customer_features(s, d), COLS)[1], None)
query("A6_one_class", lambda s, d: anomaly.one_class_scores(S.customer_features(s, d), COLS), None)
query(
    "A7_pca_reconstruction",
    lambda s, d: rounded(anomaly.reconstruction_scores(S.customer_features(s, d), ["avg_order_value", "balance"], 1), 5),
    # of two standardised columns the first direction is the diagonal their correlation points along
    f"""WITH f AS (SELECT row_id, avg_order_value AS a, balance AS b FROM ({FEATURES})),
z AS (SELECT row_id AS id, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b, sign(corr(a, b) OVER ()) AS s FROM f)
SELECT id, round((a - s * b) ** 2 / 4, 5) AS score FROM z""",
)
query("A1_isolation_forest", lambda s, d: anomaly.isolation_forest(S.customer_features(s, d), COLS), None)


def flat(spark, d) -> DataFrame:
    return S.customer_features(spark, d).select(F.col("row_id").alias("id"), F.array("recency_days", "purchase_frequency").alias("x"))


def scaled(spark, d) -> DataFrame:
    """The standardised customers as (id, x)."""
    return prep.scale(settle(S.customer_features(spark, d)), COLS).select(F.col("row_id").alias("id"), F.array(*COLS).alias("x"))


FLAT = f"SELECT row_id AS id, [recency_days, purchase_frequency] AS x FROM ({FEATURES})"
LISTED = ", ".join(f"round(list_distance(x, {c}) ** 2, 9)" for c in CENTRES)
query(
    "C3_assign_clusters",
    lambda s, d: rounded(cluster.assign(flat(s, d), CENTRES)),
    f"SELECT id, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS label, round(list_min(ds), 6) AS d2 FROM (SELECT id, [{LISTED}] AS ds FROM ({FLAT}))",
)


def lloyd_sql(k: int, rounds: int, source: str = FLAT, dims: int = 2, last: str = "SELECT id, label FROM l{0}") -> str:
    """Lloyd's rounds from the rows of the lowest ids; `last` reads the labels l{0} and their means c{1}."""
    out = f"WITH m AS ({source}), c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS label, x AS c FROM m ORDER BY id LIMIT {k})"
    means = ", ".join(f"avg(x[{i + 1}])" for i in range(dims))
    for r in range(rounds + 1):
        gap = " + ".join(f"(x[{i + 1}] - c[{i + 1}]) ** 2" for i in range(dims))
        out += f", l{r} AS (SELECT id, any_value(x) AS x, arg_min(label, (round({gap}, 9), label)) AS label FROM m, c{r} GROUP BY id)"
        out += f", c{r + 1} AS (SELECT c{r}.label, coalesce(any_value(n.c), any_value(c{r}.c)) AS c FROM c{r} LEFT JOIN (SELECT label, [{means}] AS c FROM l{r} GROUP BY 1) n USING (label) GROUP BY 1)"
    return f"{out} {last.format(rounds, rounds + 1)}"


query("C1d_lloyd_kmeans", lambda s, d: cluster.lloyd(flat(s, d), 4, 3), lloyd_sql(4, 3))


def model(spark, d) -> tuple[models.Clusters, DataFrame]:
    """Four clusters of the standardised customers, by Lloyd's rounds."""
    return models.fit_clusters(S.customer_features(spark, d), COLS, 4, fit=lambda rows, k: cluster.lloyd(rows, k, 3))


def reloaded(spark, d) -> DataFrame:
    """The same model, kept, loaded and applied to all customers."""
    path = scratch(spark, "model")
    models.save(spark, model(spark, d)[0], path, rows="customers")
    return models.load(spark, path)[0].transform(S.customer_features(spark, d))


Z = f"SELECT row_id AS id, [{SCALED}] AS x FROM ({FEATURES})"
APPLIED = lloyd_sql(4, 3, Z, 6, "SELECT id, arg_min(c{1}.label, (round(list_distance(x, c) ** 2, 9), c{1}.label)) AS label, round(min(list_distance(x, c) ** 2), 4) AS d2 FROM m, c{1} GROUP BY id")
query("C2_train_clustering", lambda s, d: rounded(model(s, d)[0].transform(S.customer_features(s, d)), 4), APPLIED)
query("L2_saved_model", lambda s, d: rounded(reloaded(s, d), 4), APPLIED)


def metrics_sql(matrix: str, dims: int) -> str:
    """The three metrics of a labelled matrix (id, x, label)."""
    of = lambda q: q.replace(MATRIX, matrix).replace("range(1, 65)", f"range(1, {dims + 1})")
    return f"(SELECT count(DISTINCT label) FROM ({matrix})) AS n_clusters, ({of(SILHOUETTE)}) AS silhouette, ({of(BOULDIN)}) AS davies_bouldin, ({of(HARABASZ)}) AS calinski_harabasz"


def settled_sql(k: int, source: str = FLAT, dims: int = 2) -> str:
    """Rows (id, x, label) after Lloyd's rounds from the rows of the lowest ids until no centre moves."""
    gap = lambda c: " + ".join(f"(x[{i + 1}] - {c}[{i + 1}]) ** 2" for i in range(dims))
    near = "[" + ", ".join(f"round({gap(f'cs[{c + 1}]')}, 9)" for c in range(k)) + "]"
    means = lambda c: ", ".join(f"avg(x[{i + 1}]) FILTER (nearest = {c + 1})" for i in range(dims))
    moved = ", ".join(f"CASE WHEN count(*) FILTER (nearest = {c + 1}) > 0 THEN [{means(c)}] ELSE any_value(cs)[{c + 1}] END" for c in range(k))
    return f"""WITH RECURSIVE m AS MATERIALIZED ({source}), c AS (SELECT 0 AS r, CAST(NULL AS DOUBLE[][]) AS before, (SELECT list(x ORDER BY id) FROM (SELECT * FROM m ORDER BY id LIMIT {k})) AS cs UNION ALL
  SELECT any_value(r) + 1, any_value(cs), [{moved}] FROM (SELECT r, cs, x, list_position(ds, list_min(ds)) AS nearest FROM (SELECT r, cs, x, {near} AS ds FROM c, m WHERE before IS DISTINCT FROM cs)) HAVING count(*) > 0)
SELECT id, x, CAST(list_position(ds, list_min(ds)) - 1 AS INTEGER) AS label FROM (SELECT id, x, {near} AS ds FROM m, (SELECT cs FROM c ORDER BY r DESC LIMIT 1))"""


SWEEP = [2, 3, 4, 5]
query(
    "E5_k_range",
    lambda s, d: rounded(models.evaluate_k_range(flat(s, d), lambda rows, k: cluster.lloyd(rows, k, None), SWEEP), 5),
    rounded_sql(" UNION ALL ".join(f"SELECT {k} AS k, {metrics_sql(settled_sql(k), 2)}" for k in SWEEP), ["silhouette", "davies_bouldin", "calinski_harabasz"], 5),
)
query("C1_kmeans", lambda s, d: cluster.kmeans(S.matrix(s, d), 5), None)
query("C4_gmm", lambda s, d: cluster.gaussian_mixture(flat(s, d), 3).select("id", "label"), None)


def parts_sql(edges: str, nodes: str) -> str:
    """A recursive part `part(id, c)`: the least id that each of `nodes` reaches over `edges` (id, j)."""
    return f"""part(id, c) USING KEY (id) AS (SELECT id, id FROM {nodes} UNION
  SELECT e.j, min(p.c) FROM part p JOIN {edges} e ON e.id = p.id JOIN recurring.part o ON o.id = e.j WHERE p.c < o.c GROUP BY e.j)"""


query(
    "C6_dbscan",
    lambda s, d: cluster.dbscan(flat(s, d), 8.0, 5),
    f"""WITH RECURSIVE m AS MATERIALIZED ({FLAT}), pairs AS MATERIALIZED (SELECT a.id, b.id AS j FROM m a JOIN m b ON list_distance(a.x, b.x) <= 8),
core AS MATERIALIZED (SELECT id FROM pairs GROUP BY id HAVING count(*) >= 5), inner_ AS MATERIALIZED (SELECT id, j FROM pairs WHERE id IN (FROM core) AND j IN (FROM core)),
{parts_sql('inner_', 'core')},
named AS (SELECT id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS label FROM part),
edge AS (SELECT pairs.id, min(label) AS label FROM pairs JOIN named ON named.id = j GROUP BY 1)
SELECT m.id, coalesce(named.label, edge.label, -1) AS label FROM m LEFT JOIN named ON named.id = m.id LEFT JOIN edge ON edge.id = m.id""",
)
query("C5_merge_tree", lambda s, d: hierarchy.hierarchical(evaluation.centroids(S.matrix(s, d)).select(F.col("label").alias("id"), F.col("centre").alias("x")), 3), None)
query(
    "C5_single_linkage",
    lambda s, d: cluster.threshold_components(flat(s, d), 4.0),
    f"""WITH RECURSIVE m AS MATERIALIZED ({FLAT}), pairs AS MATERIALIZED (SELECT a.id, b.id AS j FROM m a JOIN m b ON a.id <> b.id AND list_distance(a.x, b.x) <= 4),
{parts_sql('pairs', 'm')} SELECT id, c AS component FROM part""",
)
# a tree that is cut at a height leaves the components of all pairs within it
query(
    "C5_spanning_tree_cut",
    lambda s, d: hierarchy.cut_tree(hierarchy.tree(flat(s, d), "single"), flat(s, d).select("id"), height=6.0),
    f"""WITH RECURSIVE m AS MATERIALIZED ({FLAT}), pairs AS MATERIALIZED (SELECT a.id, b.id AS j FROM m a JOIN m b ON a.id <> b.id AND list_distance(a.x, b.x) <= 6),
{parts_sql('pairs', 'm')} SELECT id, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS label FROM part""",
)
query("C5_ward", lambda s, d: hierarchy.hierarchical(scaled(s, d), 5, "ward"), None)
query("C5_average", lambda s, d: hierarchy.hierarchical(scaled(s, d), 5, "average"), None)
query("C5_complete", lambda s, d: hierarchy.hierarchical(scaled(s, d), 5, "complete"), None)

query(
    "D1_pca_covariance",
    lambda s, d: rounded(reduce.covariance(S.customer_features(s, d), COLS), 3),
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 3) + 0e0 AS covariance FROM ({FEATURES})" for i, a in enumerate(COLS) for b in COLS[i:]),
)
query("D2_pca_reconstruction", lambda s, d: reduce.reconstruction_error(S.matrix(s, d), 2), None)
query("D1_pca_embedding", lambda s, d: reduce.principal_components(S.matrix(s, d), 2)[0], None)
query(
    "D3_kernel_double_centering",
    lambda s, d: rounded(reduce.double_centred_kernel(S.matrix(s, d), 0.2)),
    f"""WITH m AS ({MATRIX}), k AS (SELECT a.id AS i, b.id AS j, exp(-0.2e0 * list_distance(a.x, b.x) ** 2) AS k FROM m a, m b)
SELECT i, j, round(k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER (), 6) + 0e0 AS k FROM k""",
)
query("D5_locally_linear", lambda s, d: reduce.locally_linear(scaled(s, d)), None)
query("D3_kernel_components", lambda s, d: reduce.kernel_components(scaled(s, d), 2, 0.2)[0], None)
UNITS = [[0.1 * ((i + j) % 3 - 1) for i in range(64)] for j in range(3)]
Q = ", ".join(f"1 / (1 + list_distance(x, {[round(v, 6) for v in u]}) ** 2)" for u in UNITS)
query(
    "H4_student_t_q_and_p",
    lambda s, d: reduce.student_t_assignment(S.matrix(s, d), [[round(v, 6) for v in u] for u in UNITS]).select("id", *(F.round(F.col(c)[i], 6).alias(f"{c}{i}") for c in "qp" for i in range(3))),
    f"""WITH r AS (SELECT id, [{Q}] AS r FROM ({MATRIX})), q AS (SELECT id, list_transform(r, lambda v: v / list_sum(r)) AS q FROM r), f AS (SELECT [sum(q[1]), sum(q[2]), sum(q[3])] AS f FROM q),
s AS (SELECT id, q, [q[1] ** 2 / f[1], q[2] ** 2 / f[2], q[3] ** 2 / f[3]] AS s FROM q, f)
SELECT id, {', '.join(f'round(q[{i + 1}], 6) AS q{i}' for i in range(3))}, {', '.join(f'round(s[{i + 1}] / list_sum(s), 6) AS p{i}' for i in range(3))} FROM s""",
)
query("H1_autoencoder", lambda s, d: (lambda rows: deep.train_autoencoder(rows, epochs=60)[0].transform(rows))(scaled(s, d)), None)
query("H3_deep_cluster", lambda s, d: deep.deep_cluster(scaled(s, d), 4, epochs=60)[0].select("id", "label"), None)
query("H4_deep_embedded_clustering", lambda s, d: deep.deep_embedded_clustering(scaled(s, d), 4, 3, 32, pretrain_epochs=60, cluster_epochs=20)[0].select("id", "label"), None)
query("H5_contrastive", lambda s, d: (lambda rows: deep.train_contrastive(rows, 3, 32, epochs=40)[0].transform(rows))(scaled(s, d)), None)
query("H6_contrastive_cluster", lambda s, d: deep.contrastive_cluster(scaled(s, d), 4, latent_dim=3, hidden_dim=32, epochs=40)[0].select("id", "label"), None)
