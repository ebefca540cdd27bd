"""Mixtures: component weights, uncertainty, and a Dirichlet-process fit."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.functions import vectors as V
from patternloom.operators.iterate import settle
from patternloom.operators.passes import lists, matrix, summed


def effective_components(weights: DataFrame, threshold: float = 0.01) -> DataFrame:
    if not 0 <= threshold < 1:
        raise ValueError("threshold must lie in [0, 1)")
    return weights.agg(F.count_if(F.col("weight") > threshold).alias("effective"))


def weight_table(weights: DataFrame) -> DataFrame:
    """(component, weight, cumulative_weight), heaviest first, ties to the smaller component; one row per component."""
    upto = W.orderBy(F.desc("weight"), "component").rowsBetween(W.unboundedPreceding, 0)
    return weights.select("component", "weight", F.sum("weight").over(upto).alias("cumulative_weight"))


def uncertainty(df: DataFrame, p: str = "p", id_col: str = "id") -> DataFrame:
    """(id, dominant_component, max_responsibility, entropy) of an array of responsibilities."""
    return df.select(F.col(id_col).alias("id"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("dominant_component"), F.array_max(p).alias("max_responsibility"), V.entropy(F.col(p)).alias("entropy"))


def _digamma(x: np.ndarray) -> np.ndarray:
    x, shift = np.array(x, dtype=float), 0.0
    for _ in range(8):
        shift = shift + 1 / x
        x = x + 1
    f = 1 / (x * x)
    return np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f / 252)) - shift


_lgamma = np.vectorize(math.lgamma, otypes=[float])
KINDS = ("full", "tied", "diag", "spherical")
#: Added to every variance of the prior.
LEAST_VARIANCE = 1e-6


@dataclass
class DirichletMixture:
    """A fitted mixture: variational posteriors of K components in d dimensions.

    `precisions` are Cholesky factors of the expected precisions (K x d x d,
    the same K times where tied), `sticks` the two parameters of each stick.
    A precision has a Wishart posterior where it is full or tied, and one
    gamma posterior for each place, or for all, where diagonal or spherical.
    """

    kind: str
    sticks: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    freedom: np.ndarray
    precisions: np.ndarray
    bounds: list[float] = field(default_factory=list)
    converged: bool = False

    def weights(self) -> np.ndarray:
        a, b = self.sticks
        share = a / (a + b)
        w = share * np.append(1.0, np.cumprod(1 - share)[:-1])
        return w / w.sum()

    def covariances(self) -> np.ndarray:
        return np.array([np.linalg.inv(p @ p.T) for p in self.precisions])

    def steps(self, d: int) -> np.ndarray:
        """What the freedom loses from one place to the next: a Wishart's places share it, those of gammas do not."""
        return np.arange(d) if self.kind in ("full", "tied") else np.zeros(d)

    def half_log_det(self, d: int) -> np.ndarray:
        """Half the log determinants of the inverse scales of the precisions."""
        return np.array([np.log(np.diagonal(p)).sum() for p in self.precisions]) - 0.5 * d * np.log(self.freedom)

    def log_shares(self, x: np.ndarray) -> np.ndarray:
        """The log responsibilities of the components for each row."""
        d = x.shape[1]
        a, b = self.sticks
        stick = _digamma(a) - _digamma(a + b)
        log_weight = stick + np.append(0.0, np.cumsum(_digamma(b) - _digamma(a + b))[:-1])
        spread = 0.5 * (d * math.log(2) + _digamma(0.5 * (self.freedom[:, None] - self.steps(d))).sum(axis=1) - d / self.scale)
        far = np.stack([(((x - m) @ p) ** 2).sum(axis=1) for m, p in zip(self.means, self.precisions, strict=True)], axis=1)
        logs = log_weight + spread + self.half_log_det(d) - 0.5 * (d * math.log(2 * math.pi) + far)
        top = logs.max(axis=1, keepdims=True)
        return logs - top - np.log(np.exp(logs - top).sum(axis=1, keepdims=True))

    def transform(self, df: DataFrame, id_col: str = "id", x: str = "x") -> DataFrame:
        """(id, label, p) with the responsibilities `p`; no shuffle, on streams too."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    logs = shared.value.log_shares(matrix(b.column(1)))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(logs.argmax(axis=1).astype(np.int32)), lists(np.exp(logs))], names=["id", "label", "p"])

        rows = df.select(F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x"))
        return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, label int, p array<double>")


def fit_dirichlet_mixture(
    df: DataFrame, max_components: int = 10, prior: float | None = None, covariance: str = "full", max_iter: int = 200, tolerance: float = 1e-3, random_state: int = 0, id_col: str = "id", x: str = "x"
) -> DirichletMixture:
    """A Gaussian mixture of at most `max_components` under a stick-breaking prior, by variational updates.

    `covariance` is `full`, `tied` (one for all), `diag` or `spherical`;
    `prior` the concentration, by default one over the components.  Each update
    is one pass in which every task turns its rows into responsibilities and
    those into K counts, K x d sums and K x d x d sums of products; the driver
    holds those sums only.  It ends when the lower bound of the evidence rises
    by less than `tolerance`.  Runs at once.
    """
    return _fits(df, max_components, [prior], covariance, max_iter, tolerance, random_state, id_col, x)[0]


def _fits(df: DataFrame, max_components: int, priors: Sequence[float | None], covariance: str, max_iter: int, tolerance: float, random_state: int, id_col: str, x: str) -> list[DirichletMixture]:
    """A fit for each of `priors`; they share every pass until they end.  Equal rows take part once and count as many."""
    if covariance not in KINDS:
        raise ValueError(f"covariance must be one of {', '.join(KINDS)}")
    if max_components < 1 or max_iter < 1 or any(p is not None and p <= 0 for p in priors):
        raise ValueError("max_components, max_iter and prior must be positive")
    rows = settle(df.select(F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x")))
    # the starting centres lie far apart among a bounded pool of rows
    pool = np.array([r["x"] for r in rows.orderBy(F.xxhash64(F.lit(random_state), "id"), "id").limit(max(256, max_components)).collect()], dtype=float)
    if not len(pool):
        raise ValueError("no rows")
    chosen = [0]
    while len(chosen) < min(max_components, len(pool)):
        gap = ((pool[:, None, :] - pool[None, chosen, :]) ** 2).sum(axis=2).min(axis=1)
        chosen.append(int(gap.argmax()))
    first, (k, d) = pool[chosen], pool[chosen].shape
    size = k * (1 + d + d * d)
    middle = pool.mean(axis=0)  # products are of rows less this, which keeps their digits
    points = settle(rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n")))

    def sums(shares: list[Callable[[np.ndarray], np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
        """For each of `shares` counts, sums and sums of products by component, and the entropy of the responsibilities; rows less `middle`."""

        def add(b: pa.RecordBatch) -> np.ndarray:
            m, n, out = matrix(b.column(0)), b.column(1).to_numpy()[:, None], []
            c = m - middle
            for share in shares:
                r = share(m)
                entropy = -(n * r * np.log(np.maximum(r, 1e-300))).sum()
                r = n * r
                second = np.stack([(c * r[:, i : i + 1]).T @ c for i in range(k)])
                out += [r.sum(axis=0), (r.T @ c).ravel(), second.ravel(), [entropy]]
            return np.concatenate(out)

        found = summed(points, add, (size + 1) * len(shares)).reshape(len(shares), -1)
        return [(f[:k], f[k : k + k * d].reshape(k, d), f[k + k * d : size].reshape(k, d, d), float(f[-1])) for f in found]

    def nearest(m: np.ndarray) -> np.ndarray:
        return np.eye(k)[((m[:, None, :] - first[None]) ** 2).sum(axis=2).argmin(axis=1)]

    stats = sums([nearest])[0]
    n, whole = stats[0].sum(), stats[1].sum(axis=0)
    centre = whole / n
    empirical = (stats[2].sum(axis=0) - n * np.outer(centre, centre)) / max(n - 1, 1)
    shape = {"full": empirical, "tied": empirical, "diag": np.diag(np.diagonal(empirical)), "spherical": np.eye(d) * np.diagonal(empirical).mean()}[covariance]
    shape = shape + LEAST_VARIANCE * np.eye(d)
    gammas = [p or 1.0 / max_components for p in priors]
    models = [_updated(stats, middle, centre, shape, g, covariance) for g in gammas]
    for _ in range(max_iter):
        going = [i for i, m in enumerate(models) if not m.converged]
        if not going:
            break
        for i, found in zip(going, sums([lambda m, model=models[i]: np.exp(model.log_shares(m)) for i in going]), strict=True):
            bounds, models[i] = models[i].bounds, _updated(found, middle, centre, shape, gammas[i], covariance)
            models[i].bounds = [*bounds, _bound(models[i], found[3], d)]
            models[i].converged = bool(bounds) and abs(models[i].bounds[-1] - bounds[-1]) < tolerance
    return models


def _updated(stats: tuple, middle: np.ndarray, centre: np.ndarray, shape: np.ndarray, gamma: float, kind: str) -> DirichletMixture:
    """The posteriors that sums of responsibilities give: Dirichlet sticks, Gaussian means, Wishart precisions."""
    n, sx, sxx, _ = stats
    k, d = sx.shape
    n = n + 10 * np.finfo(float).eps
    mean = sx / n[:, None]
    within = sxx - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    scale = 1.0 + n
    means = (centre + n[:, None] * mean) / scale[:, None]
    gap = mean - centre
    spread = within + (n / scale)[:, None, None] * gap[:, :, None] * gap[:, None, :]
    freedom = d + n
    if kind == "full":
        wishart = shape + spread
    elif kind == "tied":
        freedom, wishart = np.full(k, d + n.sum()), np.repeat((shape + spread.sum(axis=0))[None], k, axis=0)
    elif kind == "diag":
        wishart = np.eye(d) * np.diagonal(shape + spread, axis1=1, axis2=2)[:, :, None]
    else:
        freedom, wishart = d + d * n, np.eye(d) * (shape[0, 0] + np.trace(spread, axis1=1, axis2=2))[:, None, None]
    lower = np.linalg.cholesky(wishart / freedom[:, None, None])
    precisions = np.array([np.linalg.inv(c).T for c in lower])
    sticks = np.stack([1 + n, gamma + np.append(np.cumsum(n[::-1])[-2::-1], 0.0)])
    return DirichletMixture(kind, sticks, scale, means + middle, freedom, precisions)


def _bound(model: DirichletMixture, entropy: float, d: int) -> float:
    """The lower bound of the evidence up to a constant, for the responsibilities whose entropy is given."""
    a, b = model.sticks
    places = 1 if model.kind == "spherical" else d
    det = model.half_log_det(d) * places / d
    norm = -(model.freedom * det + 0.5 * model.freedom * places * math.log(2) + _lgamma(0.5 * (model.freedom[:, None] - model.steps(places))).sum(axis=1))
    beta = (_lgamma(a) + _lgamma(b) - _lgamma(a + b)).sum()
    return float(entropy - (norm[0] if model.kind == "tied" else norm.sum()) + beta - 0.5 * d * np.log(model.scale).sum())


def dirichlet_process(
    df: DataFrame, max_components: int = 10, rounds: int = 200, prior: float | None = None, random_state: int = 0, id_col: str = "id", x: str = "x", covariance: str = "full", tolerance: float = 1e-3
) -> tuple[DataFrame, DataFrame]:
    """(id, label, p array) and (component, weight) of a `fit_dirichlet_mixture`.  Runs at once."""
    model = fit_dirichlet_mixture(df, max_components, prior, covariance, rounds, tolerance, random_state, id_col, x)
    table = df.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(model.weights())], "component int, weight double")
    return model.transform(df, id_col, x), table


def prior_sensitivity(
    df: DataFrame, priors: Sequence[float], max_components: int = 10, threshold: float = 0.01, rounds: int = 200, random_state: int = 0, id_col: str = "id", x: str = "x", covariance: str = "full", tolerance: float = 1e-3
) -> DataFrame:
    """One row: under the name of each of `priors` how many components a mixture with that prior puts to use.

    The mixtures are fitted in the same passes.  Runs at once.
    """
    if not priors:
        raise ValueError("no priors")
    if not 0 <= threshold < 1:
        raise ValueError("threshold must lie in [0, 1)")
    models = _fits(df, max_components, priors, covariance, rounds, tolerance, random_state, id_col, x)
    table = df.sparkSession.createDataFrame([(str(p), float(w)) for p, m in zip(priors, models, strict=True) for w in m.weights()], "prior string, weight double")
    return table.groupBy().pivot("prior", [str(p) for p in priors]).agg(F.count_if(F.col("weight") > threshold))
