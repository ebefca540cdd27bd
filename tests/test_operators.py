"""Operators without SQL against brute force or planted structure, and validation errors."""

import functools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternloom.operators import anomaly, cluster, cuts, drift, evaluation, explain, graph, mixture, models, order, prep, recsys, reduce, series, stability, text
import __spark_entry__ as entry
from patternloom.sources import generators
from patternloom.streaming import live


def points(spark, xs):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(xs)], "id long, x array<double>")


def test_dbscan_equals_brute_force(spark):
    r = np.random.default_rng(0)
    xs = np.concatenate([r.normal(0, 0.4, (40, 2)), r.normal(5, 0.4, (40, 2)), r.uniform(-4, 9, (20, 2))])
    near = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1)) <= 0.8
    core = near.sum(1) >= 5
    part = np.arange(len(xs))
    for _ in range(len(xs)):
        for i in np.flatnonzero(core):
            part[i] = min(part[j] for j in np.flatnonzero(near[i] & core))
    numbers = {c: k for k, c in enumerate(sorted(set(part[core])))}
    want = [numbers[part[i]] if core[i] else min((numbers[part[j]] for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(xs))]
    got = {x.id: x.label for x in cluster.dbscan(points(spark, xs), 0.8, 5).collect()}
    assert [got[i] for i in range(len(xs))] == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(i + 1, i) for i in range(200)], "id long, j long")
    for few in (0, 1_000):
        got = cluster.min_labels(edges, spark.range(205), few=few).collect()
        assert {r.id: r.component for r in got} == {i: 0 if i <= 200 else i for i in range(205)}


def test_metrics_by_hand(spark):
    four = spark.createDataFrame([(0, [0.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [10.0, 0.0], 1), (3, [10.0, 1.0], 1), (4, [5.0, 5.0], -1)], "id long, x array<double>, label int")
    found = evaluation.evaluate(four).first()
    far = (10 + math.sqrt(101)) / 2
    assert found.n_clusters == 2 and abs(found.silhouette - (far - 1) / far) < 1e-12 and abs(found.davies_bouldin - 0.1) < 1e-12
    assert evaluation.evaluate(four.where("label = 0")).first().silhouette is None
    same = four.select("label", F.col("label").alias("again"))
    assert evaluation.adjusted_rand(same, "label", "again").first()[0] == 1.0
    assert abs(evaluation.adjusted_mutual_information(evaluation.contingency(same, "label", "again")).first()[0] - 1) < 1e-9


def test_silhouettes_of_equal_rows_over_blocks(spark):
    r = np.random.default_rng(5)
    x = np.round(r.normal(size=(60, 3)), 1)
    x, label = np.concatenate([x, x[:30], x[:10]]), np.concatenate([np.arange(60) % 3, np.arange(30) % 3, np.arange(10) % 2])
    label[7] = 9  # a cluster of one
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(len(x)):
        mean = lambda m: d[i][(label == m) & (np.arange(len(x)) != i)].mean()  # noqa: B023, E731
        a, b = (mean(label[i]) if (label == label[i]).sum() > 1 else None), min(mean(m) for m in set(label) - {label[i]})
        want.append(0.0 if a is None else (b - a) / max(a, b))
    df = spark.createDataFrame([(i, v.tolist(), int(m)) for i, (v, m) in enumerate(zip(x, label, strict=True))], "id long, x array<double>, label int")
    got = {row.id: row.s for row in evaluation.silhouette_rows(df, block=16).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-12)
    assert abs(evaluation.silhouette(df, block=16).first().silhouette - np.mean(want)) < 1e-12
    plan = evaluation.silhouette(df)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_equal_rows_meet_once_within_a_distance(spark, monkeypatch):
    xs = [(0.0, 0.0)] * 300 + [(1.0, 0.0)] * 4 + [(9.0, 9.0)] * 3 + [(20.0, 0.0)]
    df, met, real = points(spark, np.array(xs)), [], cluster.within
    monkeypatch.setattr(cluster, "within", lambda rows, *a, **k: met.append(rows.count()) or real(rows, *a, **k))
    got = {r.id: r.label for r in cluster.dbscan(df, 2.0, 4).collect()}
    assert [got[i] for i in range(308)] == [0] * 304 + [-1] * 4
    parts = {r.id: r.component for r in cluster.threshold_components(df, 2.0).collect()}
    assert [parts[i] for i in range(308)] == [0] * 304 + [304] * 3 + [307]
    assert met == [4, 4]


def test_a_row_is_sent_to_few_blocks(spark):
    from patternloom.operators import graph, passes

    assert [passes.blocks(n) for n in (0, 1, 5_000, 100_000, 1_000_000)] == [1, 1, 3, 4, 31]
    xs = np.random.default_rng(2).normal(size=(90, 3))
    d = np.linalg.norm(xs[:, None] - xs[None], axis=2) + 1e9 * np.eye(90)
    for block in (16, 1_000):
        got = {(r.id, r["rank"]): r.j for r in graph.neighbours(points(spark, xs), 4, block=block).collect()}
        assert [[got[i, k] for k in range(1, 5)] for i in range(90)] == np.argsort(d, axis=1)[:, :4].tolist()


def test_a_batch_is_read_from_its_own_files(spark):
    from patternloom.operators import drift

    df = spark.range(1000).select("id", (F.col("id") % 5).cast("int").alias("batch"), F.array(F.col("id").cast("double")).alias("x"))
    rows, read = drift._apart(df, "x", "batch", "id")
    assert rows.count() == 1000 and all(f"of={b}/" in name for b in range(5) for name in read(b).inputFiles())
    assert [read(b).agg(F.sum("id")).first()[0] for b in range(5)] == [sum(range(b, 1000, 5)) for b in range(5)]
    assert drift._batch_sums(read(2), [[0.0], [1000.0]]) == {0: (100, [float(sum(range(2, 501, 5)))]), 1: (100, [float(sum(range(502, 1000, 5)))])}


def test_scaling_and_errors(spark):
    df = spark.createDataFrame([(1.0, 5), (3.0, 5)], "a double, b int")
    assert [tuple(r) for r in prep.scale(df, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        prep.scale(df, ["a"], "other")
    with pytest.raises(ValueError):
        prep.scale(df, ["missing"])
    with pytest.raises(TypeError):
        prep.scale(df.withColumn("c", F.lit("x")), ["c"])
    for bad in (lambda: cuts.quantile_threshold(df, 0.0), lambda: cuts.otsu_threshold(df, 1), lambda: drift.drift_points(df, 0), lambda: text.topic_terms(df, 0), lambda: series.shapelet_gap(df, 0.9), lambda: stability.subsample(df, 0, 0)):
        with pytest.raises(ValueError):
            bad()


def test_threshold_evaluation_by_hand(spark):
    df = spark.createDataFrame([(0, 0.0, False), (1, 1.0, False), (2, 2.0, True), (3, 3.0, True)], "id long, score double, is_anomaly boolean")
    assert tuple(cuts.evaluate_threshold(df, 2.0).first()) == (1.0, 1.0, 1.0, 2)
    low = cuts.evaluate_threshold(df, 1.0).first()
    assert abs(low.precision - 2 / 3) < 1e-12 and low.recall == 1.0
    assert cuts.evaluate_threshold(df, 9.0).first().precision is None
    places = {r.id: r.rn for r in order.ranked(df.repartition(3), "score", "id").collect()}
    assert places == {0: 0, 1: 1, 2: 2, 3: 3}


def test_isolation_forest_ranks_planted_rows_first(spark):
    rows = generators.sensors(spark, 500, 0.05, 7)
    found = anomaly.isolation_forest(rows, ["temperature", "motion_count", "power_usage", "signal_strength"], n_trees=50)
    top = found.orderBy(F.desc("score")).limit(25).join(rows, F.col("id") == F.col("row_id"))
    assert top.where("label = 'anomaly'").count() >= 22


def test_generators_do_not_depend_on_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    a = generators.customers(spark, 60, 5).orderBy("row_id").collect()
    b = generators.customers(spark, 60, 5).repartition(7).orderBy("row_id").collect()
    assert a == b and {r.segment for r in a} == set(generators.SEGMENTS)
    with pytest.raises(ValueError):
        generators.sensors(spark, 10, 0.7)
    with pytest.raises(TypeError):
        generators.customers(spark, 1.5)


def test_kmeans_and_mixture_find_blobs(spark):
    df = generators.blobs(spark, 90, [[0, 0], [10, 10], [0, 10]], 0.4)
    for labels in (cluster.kmeans(df, 3), cluster.lloyd(df, 3, 5), cluster.gaussian_mixture(df, 3)):
        assert evaluation.adjusted_rand(labels.join(df, "id"), "label", "truth").first()[0] > 0.99
    labels, weights = mixture.dirichlet_process(df, 6, 12)
    assert evaluation.adjusted_rand(labels.join(df, "id"), "label", "truth").first()[0] > 0.9
    assert abs(weights.agg(F.sum("weight")).first()[0] - 1) < 1e-6


def test_spectral_communities(spark):
    edges, nodes = generators.block_graph(spark, [20, 20], 0.6, 0.03, 3)
    labels = graph.detect_communities(edges, 2)
    assert evaluation.adjusted_rand(labels.join(nodes, "id"), "label", "truth").first()[0] > 0.8
    assert graph.modularity(edges, labels).first()[0] > 0.3
    assert abs(graph.modularity(edges, nodes.select("id", F.lit(0).alias("label"))).first()[0]) < 1e-9


def warp(a, b, band=None):
    """The warping distance by its recursion."""

    @functools.cache
    def cost(i, j):
        if i < 0 or j < 0:
            return 0.0 if i == j == -1 else math.inf
        if band is not None and abs(j - round(i * len(b) / len(a))) > band:
            return math.inf
        return (a[i] - b[j]) ** 2 + min(cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))

    return math.sqrt(cost(len(a) - 1, len(b) - 1))


def test_warping(spark):
    a, b = np.array([0.0, 1, 2, 1, 0]), np.array([0.0, 0, 1, 2, 1])
    rows = spark.createDataFrame([(0, a.tolist()), (1, b.tolist()), (2, a.tolist())], "series_id long, values array<double>")
    found = {(x.a, x.b): x.d for x in series.dtw_pairs(rows).collect()}
    assert found[0, 2] == 0 and found[0, 1] == found[1, 2] <= float(np.sqrt(((a - b) ** 2).sum())) and abs(found[0, 1] - warp(a, b)) < 1e-12
    pair = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    assert abs(pair.select(series.dtw_expression(F.col("a"), F.col("b"))).first()[0] - warp(a, b)) < 1e-12
    with pytest.raises(ValueError):
        series.dtw_pairs(rows, -1)
    with pytest.raises(ValueError):
        series.dtw_many([np.zeros(2)], [np.zeros(9)], 0)


def test_matrix_profile_finds_the_flat_stretch(spark):
    v = np.sin(np.arange(200) * 2 * np.pi / 20)
    v[100:120] = 0.3
    profile = series.matrix_profile(spark.createDataFrame(list(enumerate(v.tolist())), "pos long, v double"), 16, block=64)
    z = lambda w: (w - w.mean()) / (w.std() or 1)
    windows = [z(v[i : i + 16]) for i in range(185)]
    got = {r.pos: r.d for r in profile.collect()}
    for i in (0, 50, 110, 184):
        assert abs(got[i] - min(np.linalg.norm(windows[i] - windows[j]) for j in range(185) if abs(i - j) > 8)) < 1e-6
    picks = series.greedy(profile, 16, 3).collect()
    assert 85 <= picks[0].pos <= 120 and all(abs(p.pos - q.pos) >= 16 for p in picks for q in picks if p.pos != q.pos)


def test_svd_and_components_match_numpy(spark):
    r = np.random.default_rng(1)
    m = r.poisson(1.0, (12, 8)).astype(float)
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(8) if m[i, j]], "user_id long, item_id long, value double")
    _, items, values = recsys.svd_factors(cells, 2, 30)
    assert np.allclose(values, np.linalg.svd(m)[1][:2], rtol=1e-4)
    xs = r.normal(size=(50, 3)) @ np.diag([3, 1, 0.2])
    scores, ratio, _ = reduce.principal_components(points(spark, xs), 2)
    want = np.sort(np.linalg.eigvalsh(np.cov(xs.T, bias=True)))[::-1]
    assert np.allclose(ratio, want[:2] / want.sum()) and scores.count() == 50 and items.count() == 8


def test_nmf_lowers_the_error_and_stays_non_negative(spark):
    cells = spark.createDataFrame([(i, j, 1.0 + i % 2) for i in range(8) for j in range(6) if (i % 2) == (j % 2)], "doc long, term long, weight double")
    w, h = text.nmf(cells, 2, 15)
    err = cells.join(w, "doc").join(h, "term").select(F.pow(F.col("weight") - sum(F.col("w")[i] * F.col("h")[i] for i in range(2)), 2).alias("e")).agg(F.avg("e")).first()[0]
    assert err < 0.05 and w.where("w[0] < 0 or w[1] < 0").count() == 0


def test_monitor_sees_the_drift(spark):
    df = generators.blobs(spark, 200, [[0, 0], [3, 3]], 0.3).select("id", F.when(F.col("id") < 120, F.col("x")).otherwise(F.transform("x", lambda v: v + 8)).alias("x"), F.floor(F.col("id") / 40).cast("int").alias("batch"))
    out = drift.monitor(df, 2).orderBy("batch").collect()
    assert out[0].psi is None and out[0].centroid_shift is None and out[1].psi < 1 < out[3].psi
    assert [r.n_seen for r in out] == [40, 80, 120, 160, 200]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in/*")
    name = "live_windows"
    query = live.tumbling(stream, "1 day").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(60)
    want = {(r.start, r.event_type): (r.n, r.total) for r in live.tumbling(events, "1 day").collect()}
    assert {(r.start, r.event_type): (r.n, r.total) for r in spark.table(name).collect()} == want
    done = live.score_stream(stream, lambda d: cluster.assign(d.select(F.col("event_id").alias("id"), F.array("value").alias("x")), [[10.0], [200.0]]), f"{tmp_path}/out", f"{tmp_path}/state")
    done.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()


def test_picked_shapelets_start_anywhere_and_do_not_overlap(spark):
    found = spark.createDataFrame([("a", 1, 5.0, 0.1), ("a", 4, 4.0, 0.1), ("b", 2, 3.0, 0.1), ("a", 7, 2.0, 0.1), ("b", 3, None, None)], "cand_series string, start int, gap double, threshold double")
    assert [(r["rank"], r.cand_series, r.start) for r in series.pick_shapelets(found, 6, 9).collect()] == [(1, "a", 1), (2, "b", 2), (3, "a", 7)]
    query = entry.queries()["X8_shapelets"](spark, "/root/testdata/sf0.001").collect()
    assert query and any(r.start % 4 for r in query)
    assert all(p.cand_series != q.cand_series or abs(p.start - q.start) >= 6 for p in query for q in query if p is not q)


def test_places_of_wide_rows_over_many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        wide = spark.range(100_000).select("id", (F.xxhash64("id") % 1000 / 8).alias("score"), F.repeat(F.lit("x"), 40).alias("pad"), F.xxhash64("id").alias("more"))
        wide = wide.withColumn("score", F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("score")))  # one score fills a third
        out = order.ranked(wide, "score", "id")
        facts = out.agg(F.count(F.lit(1)), F.countDistinct("rn"), F.min("rn"), F.max("rn")).first()
        assert tuple(facts) == (100_000, 100_000, 0, 99_999) and out.columns == [*wide.columns, "rn"]
        got = [r.id for r in out.orderBy("rn").select("id").collect()]
        assert got == [r.id for r in wide.select("id", "score").orderBy("score", "id").collect()]
        batches = drift.batches(wide, 1000, "score", "more", "id")
        assert batches.count() == 100_000 and {r["count"] for r in batches.groupBy("batch").count().collect()} == {1000}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_quantiles_and_weights_in_order(spark):
    r = np.random.default_rng(4)
    a, b = r.normal(size=501), r.integers(0, 5, 501)
    df = spark.createDataFrame([(float(x), int(y), None) for x, y in zip(a, b, strict=True)], "a double, b int, c double")
    got, qs = order.quantiles(df, ["a", "b", "c"], [0.0, 0.1, 0.333, 0.5, 1.0]).first(), [0.0, 0.1, 0.333, 0.5, 1.0]
    assert np.allclose(got.a, np.quantile(a, qs)) and np.allclose(got.b, np.quantile(b, qs)) and list(got.c) == [None] * 5
    sums = order.ranked(spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "k int, w int"), "k", weight="w", into="s")
    assert {x.k: x.s for x in sums.collect()} == {1: 0, 2: 5, 3: 8}
    assert order.ranked(df.limit(0), "a").count() == 0
    ranks = anomaly.average_rank(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 3.0)], "id int, v double"), "v", "r").collect()
    assert {x.id: x.r for x in ranks} == {0: 0.5, 1: 0.5, 2: 1.0}


def test_scores_are_checked(spark):
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "score double")
    for bad in (of(1.0), of(1.0, None, 2.0), of(1.0, float("nan")), of(1.0, float("inf"))):
        for rule in (cuts.quantile_threshold, cuts.mad_threshold, cuts.otsu_threshold):
            with pytest.raises(ValueError):
                rule(bad)


def test_models_are_kept_loaded_and_applied(spark, tmp_path):
    rows = generators.customers(spark, 300, 3)
    model, labels = models.fit_clusters(rows, generators.FIELDS, 5)
    models.save(spark, model, f"{tmp_path}/m", seed=3)
    again, facts = models.load(spark, f"{tmp_path}/m")
    assert again == model and facts == {"kind": "clusters", "seed": 3}
    both = again.transform(rows).join(labels.withColumnRenamed("label", "was"), "id")
    assert both.where("label != was").count() <= 6
    assert evaluation.adjusted_rand(labels.join(rows, F.col("id") == F.col("row_id")), "label", "segment").first()[0] > 0.6
    with pytest.raises(FileNotFoundError):
        models.load(spark, f"{tmp_path}/nothing")
    forest, scores = models.train_anomaly_model(generators.sensors(spark, 300, 0.05), ["temperature", "power_usage"], 0.05)
    models.save(spark, forest, f"{tmp_path}/f")
    again = models.load(spark, f"{tmp_path}/f")[0].score(generators.sensors(spark, 300, 0.05)).withColumnRenamed("score", "s")
    assert scores.join(again, "id").where("abs(score - s) > 1e-12").count() == 0 and 10 <= scores.where("is_anomaly").count() <= 20
    with pytest.raises(ValueError):
        models.evaluate_k_range(generators.blobs(spark, 9, [[0]], 1.0), cluster.lloyd, [1])


def test_consensus_and_series_clusters(spark):
    runs = spark.createDataFrame([(r, i, (i // 4 + r) % 2 if i % 4 else (i // 4)) for r in range(3) for i in range(8)], "run int, id long, label int")
    got = {x.id: x.label for x in stability.consensus(runs, 2).collect()}
    assert got[1] == got[2] == got[3] != got[5] == got[6] == got[7]
    t = np.linspace(0, 4 * np.pi, 40)
    waves = [(i, np.sin(t + 0.2 * i).tolist()) for i in range(4)] + [(4 + i, np.sign(np.sin(2 * t + 0.2 * i)).tolist()) for i in range(4)]
    table = spark.createDataFrame(waves, "series_id long, values array<double>")
    got = {x.id: x.label for x in series.cluster_series(table, 2, 8).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[0] != got[4] and len({got[i] for i in range(4, 8)}) == 1
    r = np.random.default_rng(0)
    xs, ys = [r.normal(size=n) for n in (5, 9, 9)], [r.normal(size=n) for n in (7, 9, 9)]
    for band in (None, 4):
        assert np.allclose(series.dtw_many(xs, ys, band), [warp(x, y, band) for x, y in zip(xs, ys, strict=True)])


def test_sensitivity_and_report(spark):
    rows = generators.blobs(spark, 60, [[0, 0], [9, 9], [0, 900]], 0.5)
    table = rows.select(F.col("id").alias("row_id"), F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    fit = lambda d: cluster.lloyd(d, 3, 5)
    scalings = stability.scaling_sensitivity(table, ["a", "b"], fit)
    found = {x.scaling: x for x in scalings.collect()}
    assert set(found) == {"none", "standard", "robust"} and abs(found["standard"].ami_vs_reference - 1) < 1e-9
    outliers = stability.outlier_sensitivity(rows, fit, [0.0, 0.1])
    found = {x.level: x for x in outliers.collect()}
    assert found[0.0].n_outliers == 0 and abs(found[0.0].ami_vs_clean - 1) < 1e-9 and found[0.1].n_outliers == 6
    runs = stability.repeated_runs(rows, lambda d, seed: cluster.lloyd(d, 3, 2), 2)
    text_ = stability.report(stability.pairwise_ami(runs), stability.pairwise_ami(runs), scalings, outliers.withColumn("silhouette", F.lit(None).cast("double")))
    assert text_.count("## ") == 4 and "n/a" in text_ and "| 1.000 |" in text_
    with pytest.raises(ValueError):
        stability.scaling_sensitivity(table, ["a"], fit, reference="other")
    with pytest.raises(ValueError):
        stability.outlier_sensitivity(rows, fit, [0.5])


def test_factors_of_new_rows_and_their_error(spark):
    r = np.random.default_rng(2)
    m = r.random((9, 2)) @ r.random((2, 6))
    cells = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(9) for j in range(6)], "doc long, term long, weight double")
    w, h = text.nmf(cells, 2, 100, tolerance=1e-9)
    error = text.reconstruction_error(cells, w, h)
    assert error < 0.05 * np.linalg.norm(m)
    again = text.nmf_transform(cells.where("doc < 3"), h, 80)
    assert text.reconstruction_error(cells.where("doc < 3"), again, h) < 0.08 * np.linalg.norm(m[:3])
    with pytest.raises(ValueError):
        text.nmf(cells.withColumn("weight", F.lit(-1.0)), 2)
    one = spark.createDataFrame([("the big red fox a",)], "text string").select(text.terms(F.col("text"), 2, ("the",)).alias("t")).first().t
    assert one == ["big", "red", "fox", "big red", "red fox"]
    users, _, values = recsys.svd_factors(cells.toDF("user_id", "item_id", "value"), 2, 30)
    shares = recsys.explained_variance(users, cells.toDF("user_id", "item_id", "value"))
    assert abs(sum(shares) - 1) < 1e-6 and values[0] > values[1]


def test_projection_loses_what_numpy_says(spark):
    xs = np.random.default_rng(1).normal(size=(60, 4)) @ np.diag([3, 2, 0.5, 0.1])
    got = {x.id: x.error for x in reduce.reconstruction_error(points(spark, xs), 2).collect()}
    c = xs - xs.mean(0)
    v = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose([got[i] for i in range(60)], ((c - c @ v.T @ v) ** 2).mean(1))


def test_odd_rows_lie_outside(spark):
    rows = generators.sensors(spark, 300, 0.05, 7)
    columns = ["temperature", "power_usage", "signal_strength", "missing_ratio"]
    top = anomaly.isolation_forest(rows, columns).orderBy(F.desc("score")).limit(15).join(rows, F.col("id") == F.col("row_id"))
    assert top.where("label = 'anomaly'").count() >= 12
    # a share nu lies outside, and odd rows are much commoner there than the 5 % among all
    scores = anomaly.one_class_scores(rows, columns, nu=0.1, rounds=6)
    out = scores.where("score > 0").join(rows, F.col("id") == F.col("row_id"))
    assert 24 <= out.count() <= 36 and out.where("label = 'anomaly'").count() >= 7


def test_isomap_unrolls_an_arc(spark):
    t = np.linspace(0, 1.5 * np.pi, 60)
    got = {x.id: x.x[0] for x in graph.isomap(points(spark, np.stack([np.cos(t), np.sin(t)], 1)), 1, 4, 12).collect()}
    line = np.array([got[i] for i in range(60)])
    assert abs(np.corrcoef(line, t)[0, 1]) > 0.999
    edges, nodes = generators.block_graph(spark, [12, 12], 0.8, 0.05, 1)
    found = graph.graph_anomaly_scores(edges, nodes, 0.1)
    assert found.count() == 24 and 1 <= found.where("is_anomaly").count() <= 4


def test_neighbours_of_equal_rows_go_by_id(spark):
    xs = np.concatenate([np.zeros((50, 3)), np.random.default_rng(0).normal(size=(40, 3))])
    got = {}
    for x in graph.neighbours(points(spark, xs), 4, block=16).collect():
        got.setdefault(x.id, []).append((x["rank"], x.j))
    for i in range(90):
        d = np.round(np.sqrt(((xs - xs[i]) ** 2).sum(1)), 9)
        d[i] = np.inf
        assert [j for _, j in sorted(got[i])] == np.lexsort((np.arange(90), d))[:4].tolist()


def test_generators_follow_their_rules(spark):
    rows = generators.sensors(spark, 4000, 0.04, 1)
    calm = rows.where("label = 'normal'").agg(F.avg("temperature"), F.avg("missing_ratio"), F.avg("motion_count"), F.var_pop("motion_count")).first()
    assert rows.where("label = 'anomaly'").count() == 160 and abs(calm[0] - 21) < 0.2 and abs(calm[1] - 1.5 / 19.5) < 0.01 and abs(calm[2] - 4.95) < 0.2 and 5 < calm[3] < 9
    corpus = generators.corpus(spark).collect()
    assert len(corpus) == 140 and all(len(r.text.split()) == 22 and sum(w in generators.TOPICS[r.topic] for w in r.text.split()) == 18 for r in corpus)
    found = generators.user_items(spark, 200, 60).agg(F.count(F.lit(1)), F.avg("interaction_strength")).first()
    assert 0.08 < found[0] / 12_000 < 0.13 and abs(found[1] - 3) < 0.2


def test_cards_carry_evidence_and_no_invented_action(spark):
    rows = generators.customers(spark, 200, 2)
    cards = explain.persona_cards(rows, generators.FIELDS, "segment")
    assert cards.count("## Cluster") == cards.count("- action: undecided") == 5 and " sd)" in cards and "example" in cards
    with pytest.raises(ValueError):
        explain.distinctive_features(rows.where("segment = 'discount_seekers'"), generators.FIELDS, "segment")


def test_triangles_beside_a_hub(spark):
    r = np.random.default_rng(6)
    m = np.triu(r.random((30, 30)) < 0.3, 1)
    weights = np.where(m, r.integers(1, 4, (30, 30)), 0).astype(float)
    weights = weights + weights.T
    small = [(i, j, float(weights[i, j])) for i in range(30) for j in range(30) if weights[i, j]]
    leaves = spark.range(30, 100_030).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    edges = spark.createDataFrame(small, "src long, dst long, w double").union(leaves).union(leaves.select("dst", "src", "w"))
    found = {x.id: x for x in graph.structural_features(edges, spark.range(31)).collect()}
    for i in range(1, 30):
        d = weights[i].sum()
        tri = (weights @ weights @ weights)[i, i]
        assert abs(found[i].degree - d) < 1e-9 and abs(found[i].clustering_coefficient - (tri / (d * (d - 1)) if d > 1 else 0.0)) < 1e-9
    assert found[0].degree == weights[0].sum() + 100_000 and found[30].clustering_coefficient == 0.0


def test_rows_within_a_distance_in_many_dimensions(spark):
    r = np.random.default_rng(8)
    xs = np.concatenate([np.repeat(r.normal(size=(1, 8)), 60, axis=0) + r.normal(0, 0.01, (60, 8)), r.normal(size=(70, 8)) * np.linspace(2, 0.1, 8), 50 + r.normal(size=(5, 8))])
    got = {(x.id, x.j) for x in cluster.within(points(spark, xs), 0.9, crowd=16).collect()}
    near = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(-1)) <= 0.9
    assert got == set(zip(*map(lambda v: v.tolist(), np.nonzero(near)), strict=True)) and len(got) > 3600
    assert cluster.within(points(spark, xs), 0.9, crowd=16).count() == len(got)  # each pair once
