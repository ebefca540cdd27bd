"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text becomes a set of hashed features: its words, its runs of punctuation,
and how much of it is capitals or immediate repeats.  One weight vector serves
all grades; ordered thresholds cut the score into grades:
P(grade >= k) = 1 / (1 + exp(threshold_k - score)).  Features are screened
before the fit, so those that tell nothing have weight zero and a long text is
not judged by the sum of its noise.  Spark counts the features by grade; the
sets of those that pass come to the driver for the fit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patternloom.llm.common import cut, require, set_aside

BUCKETS = 1 << 20
TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x00-\x20]+")
SHOUT = re.compile(rb"\b[A-Z]{2,}\b")
#: At most so many labelled rows train the model, those of least hash.
MAX_LABELLED = 16_000
#: Bytes of screened feature sets that may come to the driver; with more, fewer rows train, again those of least hash.
MAX_BYTES = 128 << 20
#: Standard errors by which a feature's shares above and below some grade must differ.
LEAST_Z = 5.0
#: Documents of grade 2 have about 0.99; one toxic word takes them below this (README has figures of held-out rows).
LEAST_TAIL = 0.75


def features(text: str | None) -> np.ndarray:
    """The distinct hashed features of a text, null counting as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = TOKEN.findall(raw.lower())
    names = set(tokens)
    if tokens:
        names.add(b" repeats %d" % (10 * sum(map(eq, tokens, tokens[1:])) // len(tokens)))
        names.add(b" capitals %d" % (10 * len(SHOUT.findall(raw)) // len(tokens)))
        names.add(b" runs %d" % (10 * len(names) // len(tokens)))
    else:
        names.add(b" empty")
    return np.unique(np.fromiter(map(crc32, names), dtype=np.int64, count=len(names)) % BUCKETS)


@dataclass
class Ordinal:
    """Shared weights (of hashed features) and rising thresholds, one for each grade above the lowest."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        score = self.weights[features(text)].sum()
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, ridge: float = 0.3, slope: float = 1e-4, rounds: int = 60) -> Ordinal:
    """The penalised maximum of the likelihood of `grades` 0..K, given sets of features; unseen features weigh nothing.

    Newton's method on weights and thresholds together, each step found by
    conjugate gradients over the sparse rows, until no slope exceeds `slope` a
    row.  The log-likelihood is concave, so there is one maximum.
    """
    n, top = len(rows), int(grades.max(initial=0))
    if n == 0 or top == 0 or grades.min() == top:
        return Ordinal(np.zeros(BUCKETS), np.full(max(top, 1), -1e3))
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    used, column = np.unique(np.concatenate([*rows, np.zeros(0, dtype=np.int64)]), return_inverse=True)
    size = len(used)
    above = np.array([(np.sum(grades >= k) + 0.5) / (n + 1) for k in range(1, top + 1)])
    z = np.concatenate([np.zeros(size), -np.log(above / (1 - above))])  # weights, then thresholds

    def edges(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's score less the threshold below and above its grade."""
        score, theta = np.bincount(row, weights=p[:size][column], minlength=n), np.concatenate([[-np.inf], p[size:], [np.inf]])
        return np.minimum(score - theta[grades], 500), np.maximum(score - theta[grades + 1], -500)

    def change(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        score, theta = np.bincount(row, weights=p[:size][column], minlength=n), np.concatenate([[0.0], p[size:], [0.0]])
        return score - theta[grades], score - theta[grades + 1]

    def back(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Sums by parameter of what each row says about its two edges."""
        theta = np.bincount(grades, weights=low, minlength=top + 2) + np.bincount(grades + 1, weights=high, minlength=top + 2)
        return np.concatenate([np.bincount(column, weights=(low + high)[row], minlength=size), -theta[1 : top + 1]])

    def gain(p: np.ndarray) -> float:
        if (np.diff(p[size:]) <= 0).any():
            return -np.inf
        low, high = edges(p)
        return float(np.log(np.maximum(1 / (1 + np.exp(-low)) - 1 / (1 + np.exp(-high)), 1e-300)).sum() - 0.5 * ridge * (p[:size] ** 2).sum())

    penalty = np.concatenate([np.full(size, ridge), np.zeros(top)])
    best = gain(z)
    for _ in range(rounds):
        low, high = edges(z)
        fl, fh = 1 / (1 + np.exp(-low)), 1 / (1 + np.exp(-high))
        dl, dh, p = fl * (1 - fl), fh * (1 - fh), np.maximum(fl - fh, 1e-300)
        uphill = back(dl / p, -dh / p) - penalty * z
        if np.abs(uphill).max() <= slope * n:
            break
        ll, hh, lh = (dl / p) ** 2 - dl * (1 - 2 * fl) / p, (dh / p) ** 2 + dh * (1 - 2 * fh) / p, -dl * dh / p**2

        def bend(v: np.ndarray) -> np.ndarray:
            a, b = change(v)
            return back(ll * a + lh * b, lh * a + hh * b) + (penalty + 1e-9) * v  # noqa: B023

        step, rest = np.zeros_like(z), uphill.copy()
        way, norm = rest.copy(), rest @ rest
        for _ in range(200):
            bent = bend(way)
            rate = norm / (way @ bent)
            step, rest = step + rate * way, rest - rate * bent
            new = rest @ rest
            if new <= 1e-4 * (uphill @ uphill):
                break
            way, norm = rest + new / norm * way, new
        length = 1.0
        while length > 1e-8 and not (then := gain(z + length * step)) > best:
            length /= 2
        if length <= 1e-8:
            break
        z, best = z + length * step, then
    weights = np.zeros(BUCKETS)
    weights[used] = z[:size]
    return Ordinal(weights, z[size:])


def screened(rows: DataFrame, least_z: float) -> np.ndarray:
    """The features (of 2^20 at most) whose shares above and below some grade lie `least_z` standard errors apart, of rows (grade, set)."""
    totals = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, far = sum(totals.values()), []
    for k in sorted(totals)[1:]:
        n1 = sum(c for g, c in totals.items() if g >= k)
        n0, high = n - n1, F.sum(F.when(F.col("grade") >= k, 1).otherwise(0))
        p = (F.count(F.lit(1)) + 1) / (n + 2)
        far.append(F.abs(high / n1 - (F.count(F.lit(1)) - high) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)))
    if not far:
        return np.zeros(0, dtype=np.int64)
    apart = rows.select("grade", F.explode("set").alias("f")).groupBy("f").agg(F.greatest(*far, F.lit(0.0)).alias("z")).where(F.col("z") >= least_z)
    return np.sort(np.array([r["f"] for r in apart.select("f").collect()], dtype=np.int64))


def train(
    docs: DataFrame,
    ratings: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    max_labelled: int = MAX_LABELLED,
    max_bytes: int = MAX_BYTES,
    least_z: float = LEAST_Z,
) -> Ordinal:
    """Fit on the rated documents, the `max_labelled` of least id hash at most.

    Rows without id or grade are left out; an id rated twice has its lowest
    grade, one that several texts share stands for that of least hash.  Null
    texts count as empty.  Without two grades, or without rows, the model gives
    every document the top one.
    """
    require(docs, id_col, text_col)
    require(ratings, id_col, grade_col)
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(grade_col).cast("int").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), sets], names=["at", "grade", "set"])

    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    one = text.groupBy("_id", "grade").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = cut(one.select(F.xxhash64("_id").alias("at"), "grade", "_text").mapInArrow(extract, "at long, grade int, set array<long>"))
    good = screened(rows, least_z)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.intersect1d(np.asarray(s, dtype=np.int64), good, assume_unique=True).astype(np.int32).tobytes() for s in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary())], names=["at", "grade", "set"])

    few = cut(rows.mapInArrow(narrow, "at long, grade int, set binary"))
    size = few.agg(F.sum(F.length("set") + 100)).first()[0] or 0
    if size > max_bytes:
        few = few.where(F.pmod(F.xxhash64("at"), F.lit(1 << 20)) < int((1 << 20) * max_bytes / size))
    got = few.select("grade", "set").toPandas().sort_values(["grade", "set"])
    sets = [np.frombuffer(s, dtype=np.int32).astype(np.int64) for s in got["set"]]
    return fit(sets, got["grade"].to_numpy().astype(np.int64))


def grade_of(quality: Column, toxic: Column) -> Column:
    """Grade 0: poor; 1: sound but toxic; 2: sound and clean; null where a label is."""
    return F.when(quality.isNotNull() & toxic.isNotNull(), F.when(quality < 1, 0).when(toxic >= 1, 1).otherwise(2))


def score(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """`docs` and two columns: `expected_grade`, the sum of the tail probabilities, and `tail`, that of the top grade.

    Null and empty texts are scored as texts without words; repeated rows give
    repeated rows; an empty table gives an empty one; every other column stays,
    but columns of those two names give way to the scores.
    """
    require(docs, text_col)
    kept = docs.drop("expected_grade", "tail")
    shared, at = docs.sparkSession.sparkContext.broadcast(model), kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tails = [shared.value.tails(t) for t in b.column(at).to_pylist()]
            extra = [pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([float(t[-1]) for t in tails], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "expected_grade", "tail"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType())]))


def select(docs: DataFrame, labels: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) whose probability of the top grade is at least `least_tail`, with both scores.

    `labels` is (doc_id, quality, toxic); it is read for training only.
    """
    ratings = labels.select("doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return score(docs, train(docs, ratings)).where(F.col("tail") >= least_tail)


def keep(docs: DataFrame, labels: DataFrame, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows of `select` with the columns of `docs` as they were, whatever their names."""
    bare, back = set_aside(docs, "doc_id", "text")
    return back(select(bare, labels, least_tail))
