"""Batches of an ordered stream, and how far they drift."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.functions import vectors as V
from patternloom.operators import cluster, evaluation
from patternloom.operators.iterate import scratch, settle
from patternloom.operators.order import quantiles, ranked
from patternloom.operators.passes import matrix


def batches(df: DataFrame, batch_size: int, *order: str) -> DataFrame:
    """`df` with `batch`, consecutive runs of `batch_size` rows in the given order; the last may be short."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return ranked(df, *order, into="batch").withColumn("batch", F.floor(F.col("batch") / batch_size).cast("int"))


def population_stability(reference: DataFrame, batches: DataFrame, column: str, key: str = "batch", n_bins: int = 10, epsilon: float = 1e-6) -> DataFrame:
    """(key, psi) of every batch against the reference: bins by the reference's quantiles, shares floored at `epsilon`, 0 with fewer than two edges."""
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    cut = quantiles(reference, [column], [i / n_bins for i in range(n_bins + 1)])
    edges = cut.select(F.array_distinct(F.transform(column, lambda q: F.round(q, 9))).alias("edges"))
    inner = F.filter(F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0))), lambda e: e <= F.round(F.col(column), 9))
    one = F.broadcast(edges)
    base = reference.crossJoin(one).groupBy(F.size(inner).alias("bin")).agg(F.count(F.lit(1)).alias("e"))
    seen = batches.crossJoin(one).groupBy(F.col(key), F.size(inner).alias("bin")).agg(F.count(F.lit(1)).alias("a"))
    bins = edges.select(F.size("edges").alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    grid = batches.select(key).distinct().crossJoin(F.broadcast(bins)).join(F.broadcast(base), "bin", "left").join(seen, [key, "bin"], "left").na.fill(0, ["e", "a"])
    total = W.partitionBy(key)
    e = F.greatest(F.col("e") / F.sum("e").over(total), F.lit(epsilon))
    a = F.greatest(F.col("a") / F.sum("a").over(total), F.lit(epsilon))
    terms = grid.select(key, "n", ((a - e) * F.log(a / e)).alias("t"))
    return terms.groupBy(key).agg(F.when(F.first("n") < 2, 0.0).otherwise(F.sum("t")).alias("psi"))


def drift_points(psi: DataFrame, threshold: float = 0.25, key: str = "batch") -> DataFrame:
    """The batches strictly over the threshold; undefined ones never are."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    return psi.where(F.col("psi") > threshold).select(key)


def step_centres(centres: list[list[float]], weights: list[float], sums: dict[int, tuple[int, list[float]]]) -> tuple[list[list[float]], list[float]]:
    """Centres after one batch: each moves by its rows' mean, weighed against all rows it has had."""
    new, total = [list(c) for c in centres], list(weights)
    for k, (n, s) in sums.items():
        new[k] = [c + (v - n * c) / (weights[k] + n) for c, v in zip(centres[k], s, strict=True)]
        total[k] += n
    return new, total


def _apart(df: DataFrame, x: str, batch: str, id_col: str) -> tuple[DataFrame, Callable[[object], DataFrame]]:
    """`df` as (batch, id, x), and a function that reads one batch of it from a folder of its own, so that a pass over a batch reads no other."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "batches")
    rows = df.select(F.col(batch).alias("batch"), F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x"))
    rows.repartition("batch").withColumn("of", F.col("batch")).write.partitionBy("of").parquet(path)
    return spark.read.schema(rows.schema).parquet(path), lambda b: spark.read.schema(rows.schema).parquet(f"{path}/of={b}")


def _batch_sums(now: DataFrame, centres: list[list[float]]) -> dict[int, tuple[int, list[float]]]:
    """Rows and sums of every label in one batch, by the nearest of `centres`, the lowest on ties."""
    c = np.array(centres, dtype=float)

    def run(found):
        total = np.zeros((len(c), 1 + c.shape[1]))
        for b in found:
            v = matrix(b.column(0))
            label = np.round(((v[:, None, :] - c[None]) ** 2).sum(axis=2), 9).argmin(axis=1)
            np.add.at(total, label, np.column_stack([np.ones(len(v)), v]))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    total = sum(np.frombuffer(r["v"]).reshape(len(c), -1) for r in now.select("x").mapInArrow(run, "v binary").collect())
    return {i: (int(t[0]), t[1:].tolist()) for i, t in enumerate(total) if t[0]}


def mini_batch_kmeans(df: DataFrame, k: int, x: str = "x", batch: str = "batch", id_col: str = "id") -> tuple[list[list[float]], DataFrame]:
    """The centres after all batches in order, from the first k rows of the first, and (id, label) of every row by them.

    Each batch is one aggregate; k centres are the state.  Runs at once.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    rows, read = _apart(df, x, batch, id_col)
    order = [r[0] for r in rows.select("batch").distinct().orderBy("batch").collect()]
    if not order:
        raise ValueError("there are no batches")
    centres = [list(r["x"]) for r in read(order[0]).orderBy("id").limit(k).collect()]
    weights = [0.0] * len(centres)
    for b in order:
        centres, weights = step_centres(centres, weights, _batch_sums(read(b), centres))
    return centres, cluster.assign(rows, centres).select("id", "label")


def streaming_agreement(df: DataFrame, k: int, rounds: int = 10, x: str = "x", batch: str = "batch", id_col: str = "id") -> DataFrame:
    """(ami): how well labels learnt batch by batch agree with those of a fit on all rows at once."""
    _, live = mini_batch_kmeans(df, k, x, batch, id_col)
    whole = cluster.lloyd(df, k, rounds, id_col, x)
    both = live.withColumnRenamed("label", "a").join(whole.withColumnRenamed("label", "b"), "id")
    return evaluation.adjusted_mutual_information(evaluation.contingency(both, "a", "b"))


def monitor(df: DataFrame, k: int, drift_column: int = 0, x: str = "x", batch: str = "batch", id_col: str = "id") -> DataFrame:
    """(batch, n_seen, centroid_shift, inertia, psi): a running k-means over batches in order, from the first k rows of batch 0.

    Inertia is by the updated centres; the first batch has no shift and no psi.
    The fold over batches is ordered by nature: each batch is one pass over its
    own rows, and k centres are the state.  Runs at once.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    spark, (rows, read) = df.sparkSession, _apart(df, x, batch, id_col)
    order = [r[0] for r in rows.select("batch").distinct().orderBy("batch").collect()]
    if len(order) < 2:
        raise ValueError("at least two batches are needed")
    centres = [list(r["x"]) for r in read(order[0]).orderBy("id").limit(k).collect()]
    weights, seen, found = [0.0] * k, 0, []
    for b in order:
        sums = _batch_sums(read(b), centres)
        new, weights = step_centres(centres, weights, sums)
        shift = sum(sum((p - q) ** 2 for p, q in zip(a, c, strict=True)) ** 0.5 for a, c in zip(new, centres, strict=True)) / k
        seen += sum(n for n, _ in sums.values())
        centres = [list(map(float, c)) for c in new]
        found.append((b, seen, None if b == order[0] else float(shift), centres))
    # the centres after every batch are known, so all inertias are one pass
    table = settle(spark.createDataFrame(found, f"{batch} int, n_seen long, centroid_shift double, centres array<array<double>>"))
    near = rows.join(F.broadcast(table.select(F.col(batch).alias("batch"), "centres")), "batch")
    d2 = F.array_min(F.transform("centres", lambda c: F.round(V.squared_distance(F.col("x"), c), 9)))
    inertia = near.groupBy(F.col("batch").alias(batch)).agg(F.sum(d2).alias("inertia"))
    table = table.select(batch, "n_seen", "centroid_shift").join(inertia, batch, "left").select(batch, "n_seen", "centroid_shift", "inertia")
    values = rows.select(F.col("batch").alias(batch), F.col("x")[drift_column].alias("_v"))
    psi = population_stability(values.where(F.col(batch) == order[0]), values.where(F.col(batch) != order[0]), "_v", batch)
    return table.join(psi, batch, "left")


