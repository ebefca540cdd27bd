"""What must not grow with the square of the rows, or be moved more often than needed: against plain Python."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from patternloom.operators import evaluation, recsys, stability, text


def labellings(spark, n):
    # noise, ids that a run lacks, null labels
    rows = [(r, i, None if (i + r) % 17 == 0 else (i * (r + 1)) % 5 - 1) for r in range(3) for i in range(n) if (i + r) % 7]
    return rows, spark.createDataFrame(rows, "run int, id long, label int")


def share(rows, i, j):
    of = lambda x: {r: v for r, k, v in rows if k == x}
    a, b = of(i), of(j)
    met = [r for r in a if r in b]
    return sum(a[r] is not None and a[r] == b[r] and a[r] != -1 for r in met) / len(met) if met else None


def test_coassociation_moves_ids_and_no_pairs(spark):
    rows, runs = labellings(spark, 40)
    want = {(i, j): s for i, j in combinations(sorted({r[1] for r in rows}), 2) if (s := share(rows, i, j)) is not None}
    found = stability.coassociation(runs, block=16)
    assert {(r.i, r.j): r.share for r in found.collect()} == want
    assert {(r.i, r.j): r.share for r in stability._shares(runs, 16).collect()} == want
    # nothing is grouped by pairs
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_stability_within_clusters_joins_kinds_of_ids(spark, monkeypatch):
    rows, runs = labellings(spark, 40)
    labels = spark.createDataFrame([(i, i % 3) for i in range(40)], "id long, label int")
    known = [s for i, j in combinations(range(40), 2) if i % 3 == j % 3 and (s := share(rows, i, j)) is not None]
    assert abs(stability.intra_cluster_stability(runs, labels).first()[0] - np.mean(known)) < 1e-12
    seen, old = [], stability._shares
    monkeypatch.setattr(stability, "_shares", lambda r, **kw: seen.append(r.select("id").distinct().count()) or old(r, **kw))
    many = spark.range(3000).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("run"), "id", (F.col("id") % 4).cast("int").alias("label"))
    assert stability.intra_cluster_stability(many, many.where("run = 0").select("id", "label")).first()[0] == 1.0 and seen == [4]


def test_expected_information_of_few_large_clusters_is_shared_by_tasks(spark):
    cells = spark.createDataFrame([(a, b, 30_000 + 7_000 * (a == b)) for a in range(2) for b in range(2)], "a int, b int, n long")
    found = evaluation.adjusted_mutual_information(cells)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert f"RepartitionByExpression [ai" in plan and 0 < found.first()["ami"] < 0.1


def test_recommendations_in_batches_agree_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(recsys, "BATCH", 200)
    rng = np.random.default_rng(5)
    u, v = rng.integers(-2, 3, (30, 3)).astype(float), rng.integers(-2, 3, (50, 3)).astype(float)
    gone = {(int(a), int(b)) for a, b in zip(rng.integers(0, 30, 400), rng.integers(0, 60, 400), strict=True)} | {(3, j) for j in range(48)}
    users = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(u)], "user_id long, u array<double>")
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "item_id long, v array<double>")
    found = recsys.recommend(users, items, spark.createDataFrame(sorted(gone), "user_id long, item_id long"), 4, block=16)
    got = {(r.user_id, r["rank"]): (r.item_id, r.score) for r in found.collect()}
    want = {}
    for i in range(30):
        best = sorted((-(u[i] @ v[j]), j) for j in range(50) if (i, j) not in gone)[:4]
        want |= {(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)}
    assert got == want


def test_terms_are_counted_where_the_texts_lie(spark):
    rows = [(1, "A b-cc\tDD dd  école x1yy"), (1, "dd"), (2, None), (3, ""), (4, "Kelvin   to")]
    cells = text.counts(spark.createDataFrame(rows, "doc_id long, text string"))
    old = lambda t: [w for w in re.sub(r"\s+", " ", re.sub(r"[^a-z\s]+", " ", (t or "").lower())).strip().split(" ") if len(w) >= 2]
    want = Counter((i, w) for i, t in rows for w in old(t))
    assert {(r.doc, r.term): r.n for r in cells.collect()} == want
    plan = cells._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and plan.count("Exchange") == 1
