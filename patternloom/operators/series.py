"""Time series: warping distances, matrix profiles, shapelets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.functions import vectors as V
from patternloom.operators.iterate import settle


#: Bytes of series up to which they are broadcast.
MOST_BYTES = 64 << 20


def gather(df: DataFrame, series: str = "series_id", pos: str = "pos", v: str = "v") -> DataFrame:
    """(series_id, values): each series as one array in order of position."""
    return df.groupBy(F.col(series).alias("series_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(v).cast("double").alias("v")))), lambda s: s["v"]).alias("values"))


def dtw_many(xs: list[np.ndarray], ys: list[np.ndarray], band: int | None = None) -> np.ndarray:
    """`dtw` of many pairs at once: pairs of equal lengths share the table's rows and columns, one cell of all of them at a time."""
    out, shapes = np.zeros(len(xs)), np.array([(len(x), len(y)) for x, y in zip(xs, ys, strict=True)]).reshape(-1, 2)
    for n, m in np.unique(shapes, axis=0):
        own = np.flatnonzero((shapes == (n, m)).all(axis=1))
        if not n or not m:
            raise ValueError("a series is empty")
        a, b = np.stack([np.asarray(xs[i], dtype=float) for i in own], axis=1), np.stack([np.asarray(ys[i], dtype=float) for i in own], axis=1)
        row = np.full((m + 1, len(own)), np.inf)
        row[0] = 0.0
        for i in range(1, n + 1):
            new = np.full_like(row, np.inf)
            middle = round((i - 1) * m / n) + 1
            low, high = (1, m) if band is None else (max(1, middle - band), min(m, middle + band))
            gap, above = (a[i - 1] - b[low - 1 : high]) ** 2, np.minimum(row[low : high + 1], row[low - 1 : high])
            for j in range(low, high + 1):
                new[j] = gap[j - low] + np.minimum(above[j - low], new[j - 1])
            row = new
        if not np.isfinite(row[-1]).all():
            raise ValueError("the band is too narrow to reach the end")
        out[own] = np.sqrt(row[-1])
    return out


def dtw_pairs(series: DataFrame, band: int | None = None) -> DataFrame:
    """(a, b, d) for every pair of series a < b, both of (series_id, values): quadratic in the number of series, by definition."""
    if band is not None and band < 0:
        raise ValueError("band must not be negative")
    left, right = series.toDF("a", "va"), series.toDF("b", "vb")
    kind = dict(series.dtypes)["series_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"a": p["a"], "b": p["b"], "d": dtw_many(list(p["va"]), list(p["vb"]), band)})

    return left.join(right, F.col("a") < F.col("b")).mapInPandas(run, f"a {kind}, b {kind}, d double")


def cluster_series(series: DataFrame, k: int, band: int | None = None, linkage: str = "average") -> DataFrame:
    """(id, label): series merged down to `k` clusters by warping distance."""
    from patternloom.operators.hierarchy import merge_tree

    return merge_tree(dtw_pairs(series, band), series.select(F.col("series_id").alias("id")), k, linkage)


def dtw_expression(a: Column, b: Column) -> Column:
    """The unbanded warping distance of two short arrays inside the JVM, row by row of the table."""
    first = F.transform(b, lambda _: F.lit(float("inf")))

    def row(prev: Column, x: Column) -> Column:
        # prev = (values of the row above, value left of it)
        def cell(acc: Column, j: Column) -> Column:
            up, diagonal = F.element_at(prev["d"], j), F.when(j == 1, prev["left"]).otherwise(F.element_at(prev["d"], F.greatest(j - 1, F.lit(1))))
            left = F.element_at(acc, -1)
            gap = x - F.element_at(b, j)
            return F.concat(acc, F.array(gap * gap + F.least(up, left, diagonal)))

        # the seed stands left of the first cell
        body = F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(float("inf"))), cell)
        return F.struct(F.slice(body, 2, F.size(b)).alias("d"), F.lit(float("inf")).alias("left"))

    start = F.struct(first.alias("d"), F.lit(0.0).alias("left"))
    return F.sqrt(F.element_at(F.aggregate(a, start, row, lambda acc: acc["d"]), -1))


def euclid_pairs(series: DataFrame) -> DataFrame:
    left, right = series.toDF("a", "va"), series.toDF("b", "vb")
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", V.distance(F.col("va"), F.col("vb")).alias("d"))


def windows(series: DataFrame, window: int, pos: str = "pos", v: str = "v") -> DataFrame:
    """(pos, z): every full window of a long series (pos 0, 1, ..., v), z-normalised, from one pass of neighbours within blocks.

    Rows are copied into the block before theirs where a window can reach over,
    so no single task orders the whole series.
    """
    block = max(4096, 4 * window)
    own = F.floor(F.col(pos) / block)
    spread = F.explode(F.when((own > 0) & (F.pmod(F.col(pos), F.lit(block)) < window - 1), F.array(own, own - 1)).otherwise(F.array(own)))
    rows = series.select(F.col(pos).alias("pos"), F.col(v).cast("double").alias("v"), spread.alias("block"))
    over = W.partitionBy("block").orderBy("pos").rowsBetween(0, window - 1)
    full = rows.withColumn("w", F.collect_list("v").over(over)).where((F.size("w") == window) & (F.floor(F.col("pos") / block) == F.col("block")))
    return full.select("pos", V.z_normalised(F.col("w")).alias("z"))


def matrix_profile(series: DataFrame, window: int, exclusion: float = 0.5, pos: str = "pos", v: str = "v", block: int = 1024) -> DataFrame:
    """(pos, d, nearest): each window's least z-normalised distance to one further than bround(exclusion * window) away, the first on ties.

    Windows meet in pairs of blocks, one task each, which keep one row per window.
    """
    if window < 2 or not 0 <= exclusion < 1:
        raise ValueError("window must be at least 2, exclusion in [0, 1)")
    if series.select(F.lit(1)).limit(2 * window).count() < 2 * window:
        raise ValueError("the series is too short for two windows")
    gap = round(exclusion * window)
    z = windows(series, window, pos, v).withColumn("b", F.floor(F.col("pos") / block).cast("int"))
    blocks = z.select("b").distinct()
    left = z.join(F.broadcast(blocks.withColumnRenamed("b", "q"))).withColumnRenamed("b", "p")
    right = z.select(F.col("pos").alias("at"), F.col("z").alias("y"), F.col("b").alias("q")).join(F.broadcast(blocks.withColumnRenamed("b", "p")))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"pos": [], "d": [], "nearest": []})
        b = b.sort_values("at")
        za, zb, pa, pb = np.stack(a["z"]), np.stack(b["y"]), a["pos"].to_numpy(), b["at"].to_numpy()
        d, near = np.full(len(a), np.nan), np.full(len(a), -1)
        for first in range(0, len(a), 64):
            part = slice(first, first + 64)
            x = np.round(np.sqrt(((zb[None, :, :] - za[part, None, :]) ** 2).sum(axis=2)), 9)
            x[np.abs(pb[None, :] - pa[part, None]) <= gap] = np.inf
            k = x.argmin(axis=1)
            least = x[np.arange(len(k)), k]
            ok = np.isfinite(least)
            d[part], near[part] = np.where(ok, least, np.nan), np.where(ok, pb[k], -1)
        out = pd.DataFrame({"pos": pa, "d": d, "nearest": near})
        return out[out["nearest"] >= 0]

    parts = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "pos long, d double, nearest long")
    best = parts.groupBy("pos").agg(F.min(F.struct("d", "nearest")).alias("m"))
    return best.select("pos", F.col("m.d").alias("d"), F.col("m.nearest").alias("nearest"))


def greedy(profile: DataFrame, window: int, k: int = 1, largest: bool = True) -> DataFrame:
    """(rank, pos, d): discords (or motifs, with `largest` false) at least `window` apart, best first, ties to the first position; may be fewer than k.

    One top-1 per pick over what is left, so the profile never sits in one task.
    """
    if k < 1:
        raise ValueError("k must be positive")
    picked: list[tuple[int, int, float]] = []
    left = profile.where("d is not null")
    order = [F.desc("d") if largest else F.asc("d"), F.asc("pos")]
    for rank in range(1, k + 1):
        top = left.orderBy(*order).select("pos", "d").first()
        if top is None:
            break
        picked.append((rank, top["pos"], top["d"]))
        left = left.where(F.abs(F.col("pos") - F.lit(top["pos"])) >= window)
    return profile.sparkSession.createDataFrame(picked, "rank int, pos long, d double")


def subsequence_distance(shapelet: Column, values: Column, length: int) -> Column:
    """The least z-normalised distance of a shapelet of `length` to any stretch of an array."""
    z = V.z_normalised(shapelet)
    starts = F.sequence(F.lit(1), F.size(values) - length + 1)
    return F.array_min(F.transform(starts, lambda i: V.distance(z, V.z_normalised(F.slice(values, i, length)))))


def shapelet_gap(distances: DataFrame, min_fraction: float = 0.2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, gap, threshold) of distances (keys, id, d): the best split into near and far, mean less deviation on either side."""
    if not 0 < min_fraction <= 0.5:
        raise ValueError("min_fraction must lie in (0, 0.5]")
    by = W.partitionBy(*(keys or (F.lit(1),)))
    order = by.orderBy("d", "id")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    rows = distances.select(*keys, "id", "d", F.row_number().over(order).alias("n"), F.sum("d").over(upto).alias("s"), F.sum(F.col("d") * F.col("d")).over(upto).alias("q"))
    rows = rows.withColumn("all_n", F.count(F.lit(1)).over(by)).withColumn("all_s", F.sum("d").over(by)).withColumn("all_q", F.sum(F.col("d") * F.col("d")).over(by)).withColumn("next", F.lead("d").over(order))
    sd = lambda n, s, q: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
    far_n = F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    far_s, far_q = F.col("all_s") - F.col("s"), F.col("all_q") - F.col("q")
    gap = (far_s / far_n - sd(far_n, far_s, far_q)) - (F.col("s") / F.col("n") + sd(F.col("n"), F.col("s"), F.col("q")))
    least = F.greatest(F.lit(1), F.bround(F.lit(min_fraction) * F.col("all_n"), 0).cast("int"))
    ok = rows.where((F.col("n") >= least) & (F.col("all_n") - F.col("n") >= least)).withColumn("gap", F.round(gap, 9))
    return ok.groupBy(*keys).agg(F.max("gap").alias("gap"), F.max_by((F.col("d") + F.col("next")) / 2, F.struct("gap", -F.col("n"))).alias("threshold"))


def shapelet_candidates(series: DataFrame, window: int, stride: int = 1) -> DataFrame:
    """(cand_series, start, shapelet): every stretch of `window` values at every `stride`."""
    starts = F.sequence(F.lit(1), F.size("values") - window + 1, F.lit(stride))
    return series.select(F.col("series_id").alias("cand_series"), F.explode(F.transform(starts, lambda i: F.struct((i - 1).alias("start"), F.slice("values", i, window).alias("shapelet")))).alias("c")).select("cand_series", "c.*")


def discover_shapelets(series: DataFrame, window: int, stride: int = 1, min_fraction: float = 0.2) -> DataFrame:
    """(cand_series, start, gap, threshold) of every candidate against all series.

    Series are broadcast while their counted values stay under `MOST_BYTES`;
    beyond, candidates and series meet in a shuffled nested join.
    """
    cand = shapelet_candidates(series, window, stride)
    size = series.agg(F.sum(F.size("values") * 8 + 64)).first()[0] or 0
    met = cand.crossJoin(F.broadcast(series) if size <= MOST_BYTES else series).select("cand_series", "start", F.col("series_id").alias("id"), F.round(subsequence_distance(F.col("shapelet"), F.col("values"), window), 9).alias("d"))
    return shapelet_gap(met, min_fraction, ("cand_series", "start"))


def pick_shapelets(found: DataFrame, window: int, n: int = 1) -> DataFrame:
    """(rank, cand_series, start, gap, threshold): the candidates of the highest gaps that do not overlap within a series; may be fewer than n.

    One top-1 per pick over what is left, ties to the first series and start.
    """
    if n < 1:
        raise ValueError("n must be positive")
    left = settle(found.where("gap is not null"))
    picked: list[tuple] = []
    for rank in range(1, n + 1):
        top = left.orderBy(F.desc("gap"), "cand_series", "start").select("cand_series", "start", "gap", "threshold").first()
        if top is None:
            break
        picked.append((rank, *top))
        left = left.where((F.col("cand_series") != F.lit(top["cand_series"])) | (F.abs(F.col("start") - F.lit(top["start"])) >= window))
    kind = found.schema["cand_series"].dataType.simpleString()
    return found.sparkSession.createDataFrame(picked, f"rank int, cand_series {kind}, start int, gap double, threshold double")
