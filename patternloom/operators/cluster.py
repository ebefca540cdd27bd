"""Clustering estimators.  Labels are (id, label); noise is -1."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.functions import vectors as V
from patternloom.operators.iterate import settle
from patternloom.operators.order import quantiles, ranked
from patternloom.operators.passes import matrix, summed


def centre_array(centres: list[list[float]]) -> Column:
    """Centres as one literal array expression; k times d numbers."""
    return F.array(*(F.array(*(F.lit(float(v)) for v in c)) for c in centres))


def assign(df: DataFrame, centres: list[list[float]], id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, label, d2): the nearest of given centres, the lowest on ties; stateless, so it runs on streams too."""
    d2 = F.transform(centre_array(centres), lambda c: F.round(V.squared_distance(F.col(x), c), 9))
    return df.select(F.col(id_col).alias("id"), d2.alias("ds")).select("id", (F.array_position("ds", F.array_min("ds")) - 1).cast("int").alias("label"), F.array_min("ds").alias("d2"))


def lloyd(df: DataFrame, k: int, rounds: int | None = 3, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, label) after `rounds` fixed rounds from the rows of the `k` lowest ids, or (None) once no centre moves; a centre that loses all rows stays.

    Each round is one pass with the centres as literals and one aggregate; k
    rows reach the driver.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    rows = df.select(F.col(id_col).alias("id"), F.col(x).alias("x"))
    centres = [r["x"] for r in rows.orderBy("id").limit(k).collect()]
    for _ in itertools.count() if rounds is None else range(rounds):
        before = list(centres)
        joined = rows.withColumn("ds", F.transform(centre_array(centres), lambda c: F.round(V.squared_distance(F.col("x"), c), 9)))
        labelled = joined.select((F.array_position("ds", F.array_min("ds")) - 1).cast("int").alias("label"), "x")
        means = labelled.groupBy("label").agg(*(F.avg(F.col("x")[d]).alias(str(d)) for d in range(len(centres[0]))))
        for r in means.collect():
            centres[r["label"]] = list(r[1:])
        if rounds is None and all(list(b) == list(c) for b, c in zip(before, centres, strict=True)):
            break
    return assign(rows, centres).select("id", "label")


def kmeans(df: DataFrame, k: int, n_init: int = 10, random_state: int = 0, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, label) of the cheapest of `n_init` k-means fits.  Fits at once."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k < 2:
        raise ValueError("k must be at least 2")
    rows = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(x)).alias("features")).cache()
    models = [KMeans(k=k, seed=random_state + i, maxIter=50).fit(rows) for i in range(n_init)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    out = best.transform(rows).select("id", F.col("prediction").cast("int").alias("label"))
    rows.unpersist()
    return out


def gaussian_mixture(df: DataFrame, k: int, random_state: int = 0, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, label, probability array) of a full-covariance mixture.  Fits at once."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(F.col(id_col).alias("id"), array_to_vector(F.col(x)).alias("features"))
    model = GaussianMixture(k=k, seed=random_state, maxIter=60).fit(rows)
    return model.transform(rows).select("id", F.col("prediction").cast("int").alias("label"), vector_to_array("probability").alias("probability"))


#: Rows of one side that meet in one key of `within`.
CROWD = 4_096


def _axes(rows: DataFrame, d: int) -> np.ndarray:
    """Up to three unit directions, as columns, along which rows of `d` numbers spread most."""
    if d <= 3:
        return np.eye(d)
    middle = np.array(rows.first()["x"], dtype=float)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0)) - middle
        return np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])

    found = summed(rows.select("x"), moments, 1 + d + d * d)
    n, mean = found[0], found[1 : 1 + d] / found[0]
    return np.linalg.eigh(found[1 + d :].reshape(d, d) / n - np.outer(mean, mean))[1][:, ::-1][:, :3]


def within(df: DataFrame, eps: float, id_col: str = "id", x: str = "x", crowd: int = CROWD) -> DataFrame:
    """(id, j) for all rows within `eps`, itself included.

    Rows are put in cells a little over `eps` wide along the three directions
    of greatest spread.  No direction makes two rows further apart than they
    are, so rows within `eps` lie in neighbouring cells, and distances are then
    taken in full.  A cell of more than `crowd` rows, and the rows around it,
    meet in parts.
    """
    rows = df.select(F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    d = rows.agg(F.max(F.size("x"))).first()[0] or 0
    axes, width = _axes(rows, d), eps * (1 + 1e-9)
    along = [sum((F.col("x")[i] * float(v) for i, v in enumerate(a) if v), F.lit(0.0)) for a in axes.T] or [F.lit(0.0)]
    own = rows.select("id", "x", F.array(*(F.floor(a / width) for a in along)).alias("cell"))
    steps = F.array(*(F.array(*map(F.lit, s)) for s in itertools.product((-1, 0, 1), repeat=len(along))))
    around = F.explode(F.transform(steps, lambda s: F.zip_with("cell", s, lambda c, k: c + k)))
    counts = settle(own.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    near = counts.select(around.alias("to"), "n").withColumnRenamed("to", "cell").groupBy("cell").agg(F.sum("n").alias("m"))
    parts = settle(counts.join(near, "cell").select("cell", F.ceil(F.col("n") / crowd).cast("int").alias("nq"), F.ceil(F.col("m") / crowd).cast("int").alias("np")))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = own.select("id", "x", around.alias("to")).withColumnRenamed("to", "cell").join(parts, "cell").select("id", "x", "cell", dealt("np").alias("p"), each("nq").alias("q"))
    right = own.join(parts, "cell").select(F.col("id").alias("j"), F.col("x").alias("y"), "cell", dealt("nq").alias("q"), each("np").alias("p"))
    return left.join(right, ["cell", "p", "q"]).where(V.distance(F.col("x"), F.col("y")) <= eps).select("id", "j")


def alike(df: DataFrame, id_col: str = "id", x: str = "x") -> tuple[DataFrame, DataFrame]:
    """The different rows (id, x, n), each under its least id and there `n` times, and (id, to): every id and the least id of its equals.  Runs at once."""
    rows = settle(df.select(F.col(id_col).alias("id"), F.col(x).alias("x")))
    points = settle(rows.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "x", "n"))
    return points, rows.join(points.select("x", F.col("id").alias("to")), "x").select("id", "to")


#: Edges that one task may join up by itself.
FEW_EDGES = 200_000


def _joined_up(edges: pd.DataFrame) -> pd.DataFrame:
    """(hi, lo): every end of the edges with another least id that it reaches."""
    up: dict = {}

    def top(v):
        while (u := up.get(v, v)) != v:
            up[v] = v = up.get(u, u)
        return v

    for a, b in zip(edges["hi"].tolist(), edges["lo"].tolist(), strict=True):
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pd.DataFrame([(v, top(v)) for v in list(up)], columns=["hi", "lo"])


def min_labels(edges: DataFrame, vertices: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(id, component): the least id each vertex reaches over edges (id, j), given in both directions.

    Up to `few` edges are joined up in one task.  Of more,
    every vertex hands its larger neighbours to its least one, then its
    smaller neighbours too, until the edges are stars; the rounds grow with the
    logarithm of the longest chain.  Only a change count reaches the driver.
    """
    now, before = settle(edges.where("id > j").select(F.col("id").alias("hi"), F.col("j").alias("lo")).distinct()), None
    named = lambda stars: vertices.select("id").join(stars.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    if now.count() <= few:
        kind = now.schema["hi"].dataType.simpleString()
        return named(now.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_joined_up, f"hi {kind}, lo {kind}"))
    for _ in range(max_rounds):
        both = now.union(now.select("lo", "hi").toDF("hi", "lo"))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = settle(both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct())
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        rest = large.join(low, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        now = settle(rest.union(low.toDF("hi", "lo")).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == before:
            return named(now)
        before = seen
    raise RuntimeError(f"labels did not settle in {max_rounds} rounds")


def dbscan(df: DataFrame, eps: float, min_samples: int = 5, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, label): clusters numbered from 0 by their least core id, -1 for noise; a border row joins the least adjacent cluster."""
    if eps <= 0 or min_samples < 1:
        raise ValueError("eps and min_samples must be positive")
    # equal rows have the same neighbours, so one stands for all and counts as many
    points, to = alike(df, id_col, x)
    pairs = settle(within(points, eps))
    weights = points.select(F.col("id").alias("j"), "n")
    core = settle(pairs.join(weights, "j").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id"))
    inner = pairs.join(core, "id").join(core.withColumnRenamed("id", "j"), "j").select("id", "j")
    parts = min_labels(inner, core)
    numbers = ranked(parts.select("component").distinct(), "component", into="label").withColumn("label", F.col("label").cast("int"))
    named = parts.join(numbers, "component").select("id", "label")
    border = pairs.join(named.select(F.col("id").alias("j"), "label"), "j").groupBy("id").agg(F.min("label").alias("edge"))
    found = points.select("id").join(named, "id", "left").join(border, "id", "left").select(F.col("id").alias("to"), F.coalesce("label", "edge", F.lit(-1)).cast("int").alias("label"))
    return to.join(found, "to").select("id", "label")


def knn_eps(df: DataFrame, k: int = 10, q: float = 0.85, id_col: str = "id", x: str = "x") -> DataFrame:
    """The `q` quantile of the distance to the k-th nearest row, a row counting as its own first."""
    from patternloom.operators.graph import neighbours

    far = neighbours(df, k - 1, id_col, x).groupBy("id").agg(F.max("d").alias("d"))
    return quantiles(far, ["d"], [q]).select(F.col("d")[0].alias("eps"))


def threshold_components(df: DataFrame, height: float, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, component): single linkage cut at `height`, which is the components of all pairs within it."""
    points, to = alike(df, id_col, x)
    found = min_labels(within(points, height).where("id != j"), points.select("id"))
    return to.join(found.select(F.col("id").alias("to"), "component"), "to").select("id", "component")
