"""Anomaly detectors and ensembles of their scores."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.functions import vectors as V
from patternloom.operators.graph import neighbours
from patternloom.operators.iterate import settle
from patternloom.operators.order import quantiles, ranked
from patternloom.operators.passes import lists, matrix, summed
from patternloom.operators.prep import numeric, scale
from patternloom.operators.reduce import reconstruction_error


def zscore(df: DataFrame, column: str) -> DataFrame:
    facts = df.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    return df.crossJoin(F.broadcast(facts)).withColumn("z", F.abs(F.col(column) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_m", "_s")


def local_outlier_factor(df: DataFrame, k: int = 20, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, lof) from the k nearest neighbours of each row: three joins on the neighbour table."""
    near = neighbours(df, k, id_col, x)
    reach_of = near.groupBy("id").agg(F.max("d").alias("kd"))
    reached = near.join(reach_of.toDF("j", "kdj"), "j").select("id", "j", F.greatest("d", "kdj").alias("reach"))
    density = reached.groupBy("id").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    both = near.join(density.toDF("j", "lj"), "j").groupBy("id").agg(F.avg("lj").alias("m")).join(density, "id")
    return both.select("id", (F.col("m") / F.col("lrd")).alias("lof"))


def mahalanobis_2d(df: DataFrame, a: str, b: str) -> DataFrame:
    """`df` with `distance`, the Mahalanobis distance by the population covariance of two columns."""
    f = df.agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.covar_pop(a, a).alias("_saa"), F.covar_pop(a, b).alias("_sab"), F.covar_pop(b, b).alias("_sbb"))
    da, db = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb")
    det = F.col("_saa") * F.col("_sbb") - F.col("_sab") * F.col("_sab")
    d2 = (F.col("_sbb") * da * da - 2 * F.col("_sab") * da * db + F.col("_saa") * db * db) / det
    return df.crossJoin(F.broadcast(f)).withColumn("distance", F.sqrt(F.greatest(d2, F.lit(0.0)))).drop("_ma", "_mb", "_saa", "_sab", "_sbb")


def robust_distances_2d(df: DataFrame, a: str, b: str, id_col: str, fraction: float = 0.75, steps: int = 3) -> DataFrame:
    """As `mahalanobis_2d`, by the rows of least distance: each step refits on the closest `fraction`, which a quantile cut picks."""
    now = mahalanobis_2d(df, a, b)
    for _ in range(steps):
        cut = quantiles(now.select(F.round("distance", 9).alias("_cut")), ["_cut"], [fraction]).select(F.col("_cut")[0].alias("_cut"))
        core = now.crossJoin(F.broadcast(cut)).where(F.round("distance", 9) <= F.col("_cut"))
        f = core.agg(F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.covar_pop(a, a).alias("_saa"), F.covar_pop(a, b).alias("_sab"), F.covar_pop(b, b).alias("_sbb"))
        da, db = F.col(a) - F.col("_ma"), F.col(b) - F.col("_mb")
        det = F.col("_saa") * F.col("_sbb") - F.col("_sab") * F.col("_sab")
        d2 = (F.col("_sbb") * da * da - 2 * F.col("_sab") * da * db + F.col("_saa") * db * db) / det
        now = df.crossJoin(F.broadcast(f)).withColumn("distance", F.sqrt(F.greatest(d2, F.lit(0.0)))).drop("_ma", "_mb", "_saa", "_sab", "_sbb")
    return now


def mean_ensemble(df: DataFrame, members: Sequence[str]) -> DataFrame:
    return df.withColumn("ensemble", sum((F.col(m) for m in members[1:]), F.col(members[0])) / len(members))


def average_rank(df: DataFrame, column: str, into: str) -> DataFrame:
    """`df` with the average rank of `column` over the row count, equal values sharing theirs.

    Ranks come from one row per distinct value; those are put in order by ranges.
    """
    per = settle(df.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    total = per.agg(F.sum("_c").alias("_n"))
    ranks = ranked(per, "_v", weight="_c", into="_b").crossJoin(F.broadcast(total)).select("_v", (F.col("_b") + (F.col("_c") + 1) / 2.0).alias("_r"), "_n")
    return df.join(ranks, F.col(column) == F.col("_v")).withColumn(into, F.col("_r") / F.col("_n")).drop("_v", "_r", "_n")


def rank_ensemble(df: DataFrame, members: Sequence[str]) -> DataFrame:
    out = df
    for m in members:
        out = average_rank(out, m, f"_rank_{m}")
    total = sum((F.col(f"_rank_{m}") for m in members[1:]), F.col(f"_rank_{members[0]}")) / len(members)
    return out.withColumn("ensemble", total).drop(*(f"_rank_{m}" for m in members))


def review_table(df: DataFrame, score: str, id_col: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(score), id_col).limit(n)


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Isolation trees, each as arrays over its nodes: column (-1 for a leaf), cut, child below, child above, path length of a leaf."""

    columns: list[str]
    trees: list[tuple]
    expected: float

    def score(self, df: DataFrame, id_col: str = "row_id") -> DataFrame:
        """(id, score): 2^(-mean path / expected path), higher is odder; rows with a null or NaN have no score.

        The trees have under 2 * sample nodes each and are broadcast; rows are
        scored in Arrow batches without a shuffle, on streams too.
        """
        numeric(df, self.columns)
        names, expected = [f"c{i}" for i in range(len(self.columns))], self.expected
        rows = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(n) for c, n in zip(self.columns, names, strict=True))).na.drop(subset=names)
        forest = df.sparkSession.sparkContext.broadcast([tuple(np.asarray(v) for v in t) for t in self.trees])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x, total = b[names].to_numpy(), np.zeros(len(b))
                for column, cut, low, high, path in forest.value:
                    at = np.zeros(len(x), dtype=np.int64)
                    while (inner := column[at] >= 0).any():
                        i = np.flatnonzero(inner)
                        at[i] = np.where(x[i, column[at[i]]] < cut[at[i]], low[at[i]], high[at[i]])
                    total += path[at]
                yield pd.DataFrame({"id": b["id"], "score": 2.0 ** (-total / max(1, len(forest.value)) / expected)})

        return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, score double")


def fit_forest(df: DataFrame, columns: Sequence[str], id_col: str = "row_id", n_trees: int = 100, sample: int = 256, random_state: int = 0) -> Forest:
    """Trees over samples of the rows of least hash, found by one bounded top-k and grown on the driver.  Fits at once."""
    numeric(df, columns)
    rows = df.select(F.col(id_col).alias("id"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))).na.drop(subset=[f"c{i}" for i in range(len(columns))])
    keyed = rows.withColumn("_h", F.xxhash64(F.lit(random_state), "id"))
    pool = keyed.orderBy("_h", "id").limit(min(sample * n_trees, 25_600)).drop("_h", "id").toPandas().to_numpy()
    r, trees = np.random.default_rng(random_state), []
    size = min(sample, len(pool))
    depth = max(1, math.ceil(math.log2(max(size, 2))))
    for _ in range(n_trees if size else 0):
        nodes: list[tuple[int, float, int, int, float]] = []
        stack = [(pool[r.choice(len(pool), size, replace=False)], 0, -1, 0)]
        while stack:
            x, level, parent, side = stack.pop()
            if parent >= 0:
                nodes[parent] = (*nodes[parent][: 2 + side], len(nodes), *nodes[parent][3 + side :])
            spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else np.zeros(0, dtype=int)
            if level >= depth or len(x) <= 1 or not len(spread):
                nodes.append((-1, 0.0, -1, -1, level + _average_path(len(x))))
                continue
            c = int(r.choice(spread))
            at = float(r.uniform(x[:, c].min(), x[:, c].max()))
            nodes.append((c, at, -1, -1, 0.0))
            here, left = len(nodes) - 1, x[:, c] < at
            stack += [(x[~left], level + 1, here, 1), (x[left], level + 1, here, 0)]
        trees.append(tuple(np.array(v).tolist() for v in zip(*nodes, strict=True)))
    return Forest(list(columns), trees, _average_path(size) or 1.0)


def isolation_forest(df: DataFrame, columns: Sequence[str], id_col: str = "row_id", n_trees: int = 100, sample: int = 256, random_state: int = 0) -> DataFrame:
    """(id, score) of the rows by a forest fitted on them."""
    return fit_forest(df, columns, id_col, n_trees, sample, random_state).score(df, id_col)


def flagged(scores: DataFrame, contamination: float, score: str = "score") -> DataFrame:
    """`scores` with `is_anomaly`: at or over the quantile that leaves a share of `contamination`."""
    if not 0 < contamination < 0.5:
        raise ValueError("contamination must lie between 0 and 0.5")
    cut = quantiles(scores, [score], [1 - contamination]).select(F.col(score)[0].alias("_cut"))
    return scores.crossJoin(F.broadcast(cut)).withColumn("is_anomaly", F.col(score) >= F.col("_cut")).drop("_cut")


def reconstruction_scores(df: DataFrame, columns: Sequence[str], d: int, id_col: str = "row_id") -> DataFrame:
    """(id, score): the mean squared error of each standardised row after projection on `d` principal components."""
    x = scale(df, columns).select(F.col(id_col).alias("id"), F.array(*columns).alias("x"))
    return reconstruction_error(x, d).withColumnRenamed("error", "score")


def one_class_scores(df: DataFrame, columns: Sequence[str], nu: float = 0.04, gamma: float | None = None, n_features: int = 64, rounds: int = 25, random_state: int = 0, id_col: str = "row_id") -> DataFrame:
    """(id, score): how far each row lies outside the region that holds all but a share `nu` of the rows.

    An approximation of the one-class support vector machine with an rbf
    kernel (`gamma`, by default one over the number of columns): random Fourier
    features of the standardised rows, and subgradient steps on its linear
    objective; each step is one aggregate of `n_features` sums.  Runs at once.
    """
    if not 0 < nu < 1:
        raise ValueError("nu must lie between 0 and 1")
    r, d = np.random.default_rng(random_state), len(columns)
    lines, shift = r.standard_normal((n_features, d)) * math.sqrt(2 * (gamma or 1 / d)), r.uniform(0, 2 * math.pi, n_features)
    x = F.array(*columns)
    parts = [math.sqrt(2 / n_features) * F.cos(V.dot(x, F.array(*map(F.lit, a.tolist()))) + float(b)) for a, b in zip(lines, shift, strict=True)]
    rows = settle(scale(df, columns).select(F.col(id_col).alias("id"), F.array(*parts).alias("z")))
    n = rows.count()
    w, rho = np.array(rows.agg(*(F.avg(F.col("z")[i]) for i in range(n_features))).first(), dtype=float), 0.0
    height = lambda w: V.dot(F.col("z"), F.array(*map(F.lit, w.tolist())))
    for t in range(rounds):
        # the best offset for given weights is their nu quantile; a sketch of it is good enough for a step
        rho = rows.select(height(w).alias("h")).approxQuantile("h", [nu], 0.001)[0]
        out = rows.where(height(w) < rho).agg(*(F.sum(F.col("z")[i]) for i in range(n_features))).first()
        w = w - (w - np.array([v or 0.0 for v in out]) / (nu * n)) / (t + 2)
    rho = rows.select(height(w).alias("h")).approxQuantile("h", [nu], 0.0005)[0]
    return rows.select("id", (F.lit(rho) - height(w)).alias("score"))


def chi_square_quantile(p: float, d: int) -> float:
    """The value that a share `p` of sums of `d` squared normal draws stays below, by halving on the incomplete gamma series."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")

    def below(x: float) -> float:
        a, h = d / 2, x / 2
        term = total = math.exp(a * math.log(h) - h - math.lgamma(a + 1))
        k = 0
        while term > 1e-17 * total or h > a + k:
            k += 1
            term *= h / (a + k)
            total += term
        return total

    low, high = 1e-12, d + 20 * math.sqrt(2 * d) + 60
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return (low + high) / 2


def _parts(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and population covariances from rows of (count, sums, sums of products)."""
    n = np.maximum(sums[:, 0], 1.0)
    mean = sums[:, 1 : 1 + d] / n[:, None]
    second = sums[:, 1 + d :].reshape(-1, d, d) / n[:, None, None]
    return sums[:, 0], mean, second - mean[:, :, None] * mean[:, None, :]


def _squares(x: np.ndarray, means: np.ndarray, inverses: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances, a column for each mean."""
    return np.stack([((x - m) @ v * (x - m)).sum(axis=1) for m, v in zip(means, inverses, strict=True)], axis=1)


def _precisions(covariances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses and log determinants, with what keeps a flat one invertible."""
    d = covariances.shape[1]
    ridge = 1e-12 * np.maximum(np.trace(covariances, axis1=1, axis2=2) / d, 1e-300)
    safe = covariances + ridge[:, None, None] * np.eye(d)
    return np.linalg.inv(safe), np.linalg.slogdet(safe)[1]


def robust_distances(
    df: DataFrame, columns: Sequence[str], id_col: str = "row_id", support: float | None = None, starts: int = 30, kept: int = 5, max_steps: int = 30, random_state: int = 0
) -> DataFrame:
    """(id, distance): Mahalanobis distances by the covariance of the half of the rows whose determinant is least.

    All starts, each the moments of a few rows of least hash, go on together:
    a step is one aggregate that finds, for each of them, how far its closest
    share of rows reaches, and one pass that sums the moments of those rows.
    After two steps the `kept` best of them go on until no determinant falls.
    The best is scaled so that its median distance is that of normal rows, and
    refitted once on the rows within the 97.5 % distance.  `support` is the share
    of rows that count, by default half of them and a few more.  The reach is
    exact up to 10,000 rows, and one of some 1 / 10,000 of the rows' places
    beyond.  Rows with a null or NaN have no distance.  Runs at once.
    """
    numeric(df, columns)
    d = len(columns)
    x = F.array(*(F.col(c).cast("double") for c in columns))
    rows = df.select(F.col(id_col).alias("id"), x.alias("x")).where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = settle(rows)
    n = rows.count()
    if n <= d + 1:
        raise ValueError("more rows than columns are needed")
    if support is not None and not 0.5 <= support <= 1:
        raise ValueError("support must lie in [0.5, 1]")
    h = (n + d + 1) // 2 if support is None else max(d + 1, math.ceil(support * n))
    pool = rows.orderBy(F.xxhash64(F.lit(random_state), "id"), "id").limit(starts * (d + 1)).collect()
    pool = np.array([r["x"] for r in pool], dtype=float)
    middle = pool.mean(axis=0)  # sums of products of rows far from zero would lose their covariance to rounding
    pool, rows = pool - middle, settle(rows.select("id", F.zip_with("x", F.array(*map(F.lit, middle.tolist())), lambda a, b: a - b).alias("x")))
    groups = [pool[i : i + d + 1] for i in range(0, len(pool) - d, d + 1)]
    means = np.array([g.mean(axis=0) for g in groups])
    inverses, dets = _precisions(np.array([np.cov(g.T, bias=True).reshape(d, d) for g in groups]))

    def step(means: np.ndarray, inverses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = _reach(rows, means, inverses, (h - 0.5) / n)
        _, means, covariances = _parts(_sums_within(rows, means, inverses, reach, d), d)
        return means, covariances

    for _ in range(2):
        means, covariances = step(means, inverses)
        inverses, dets = _precisions(covariances)
    best = np.argsort(dets, kind="stable")[:kept]
    means, covariances, inverses, dets = means[best], covariances[best], inverses[best], dets[best]
    for _ in range(max_steps):
        new_means, new_covariances = step(means, inverses)
        new_inverses, new_dets = _precisions(new_covariances)
        falls = new_dets < dets - 1e-10
        means[falls], covariances[falls], inverses[falls], dets[falls] = new_means[falls], new_covariances[falls], new_inverses[falls], new_dets[falls]
        if not falls.any():
            break
    b = int(np.argmin(dets))
    mean, covariance = means[b : b + 1], covariances[b : b + 1]
    median = _reach(rows, mean, inverses[b : b + 1], 0.5)[0]
    covariance = covariance * max(median, 1e-300) / chi_square_quantile(0.5, d)
    inverse, _ = _precisions(covariance)
    _, mean, covariance = _parts(_sums_within(rows, mean, inverse, np.array([chi_square_quantile(0.975, d)]), d), d)
    inverse, _ = _precisions(covariance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.sqrt(np.maximum(_squares(matrix(b.column(1)), mean, inverse)[:, 0], 0.0)))], names=["id", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, distance double")


def _reach(rows: DataFrame, means: np.ndarray, inverses: np.ndarray, share: float) -> np.ndarray:
    """For each mean the squared distance within which a `share` of the rows lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([lists(_squares(matrix(b.column(1)), means, inverses))], names=["d"])

    far = rows.mapInArrow(run, "d array<double>")
    return np.array(far.agg(*(F.percentile_approx(F.col("d")[i], share, 10_000) for i in range(len(means)))).first(), dtype=float)


def _sums_within(rows: DataFrame, means: np.ndarray, inverses: np.ndarray, reach: np.ndarray, d: int) -> np.ndarray:
    """For each mean the count, sums and sums of products of the rows within its reach."""

    def add(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(1))
        inside = _squares(x, means, inverses) <= reach
        return np.concatenate([np.concatenate([[i.sum()], x[i].sum(axis=0), (x[i].T @ x[i]).ravel()]) for i in inside.T])

    return summed(rows, add, len(means) * (1 + d + d * d)).reshape(len(means), -1)
