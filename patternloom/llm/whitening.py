"""Whitening of embeddings along leading components, by block Lanczos without a covariance matrix.

A vector c becomes the integers x = floor(scale * c) + shift.  The fit knows the
data only through passes that take a block Q of b directions to the sum over
all rows of (x - S/n) times its projections on Q, divided by n: a product of
the covariance with Q, of dim x b numbers, whatever the number of rows.  New
directions are made orthogonal to all earlier ones, twice; a block that loses
rank is filled up with fresh directions, which is a restart that keeps what is
known; and the fit ends when the residuals of all wanted components, which the
kept products give exactly, are within rounding of zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import require

SCALE, SHIFT = 1024, 100_000
#: Largest |scale * c| of a usable entry; sums of as many rows as there may be fit a long.
MOST = float(1 << 31)
#: A residual within this share of the largest eigenvalue is rounding.
TOLERANCE = 1e-13
#: An eigenvalue within this share of the trace is zero, and no component.
NOTHING = 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite and at most `MOST` when scaled."""
    entry = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) <= MOST / SCALE)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry), F.lit(False))


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the usable rows of the commonest length, the greater one on ties."""
    require(vectors, id_col, vector_col)
    rows = vectors.where(usable(F.col(vector_col)))
    lengths = rows.groupBy(F.size(vector_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    x = F.transform(vector_col, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.where(F.size(vector_col) == (most["d"] if most else 0)).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def total(rows: DataFrame, add: Callable[[np.ndarray], np.ndarray], size: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows of `add` of blocks of their x (rows by dim), an array of `size` numbers, of doubles or longs.

    A task sums its own rows and hands on `size` numbers; Spark adds those up
    place by place, so the driver gets `size` numbers whatever the rows.
    """

    dtype = {"double": np.float64, "long": np.int64}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype=dtype)
        for b in batches:
            if b.num_rows:
                found += add(block(b.column(0))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(found)], names=["i", "v"])

    summed = rows.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(size, dtype=dtype)
    for r in summed.collect():
        out[r["i"]] = r["v"]
    return out


def block(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of longs as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def moments(rows: DataFrame) -> tuple[int, np.ndarray]:
    """The number of rows and the sums of each of their places, exact."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return 0, np.zeros(0, dtype=np.int64)
    found = total(rows, lambda x: np.append(x.sum(axis=0), len(x)), first["d"] + 1, "long")
    return int(found[-1]), found[:-1]


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n with the difference taken in integers."""
    return (n * x - sums) / n


def components(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 0, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The `k` greatest eigenvalues of the symmetric matrix behind `product`, falling, and their unit vectors as columns.

    `product` takes a block of dim x b to the matrix times it.  The sign of a
    vector makes its entry of greatest magnitude positive.
    """
    k, random = min(k, dim), np.random.default_rng(seed)
    basis, images = np.zeros((dim, 0)), np.zeros((dim, 0))
    new = random.normal(size=(dim, min(dim, k)))
    while True:
        q = _orthonormal(new, basis, random)
        basis, images = np.hstack([basis, q]), np.hstack([images, product(q)])
        small = basis.T @ images
        values, inner = np.linalg.eigh((small + small.T) / 2)
        values, inner = values[::-1][:k], inner[:, ::-1][:, :k]
        vectors = basis @ inner
        residual = images @ inner - vectors * values
        within = np.linalg.norm(residual, axis=0) <= tolerance * max(abs(values[0]), np.finfo(float).tiny)
        if basis.shape[1] == dim or within.all():
            break
        new = images[:, -q.shape[1] :]
    vectors = vectors / np.linalg.norm(vectors, axis=0)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def _orthonormal(new: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Unit columns orthogonal to each other and to `basis`, as many as `new` has and space is left.

    Two sweeps against all earlier columns.  A column with nothing left of its
    own after that is a breakdown; a random one takes its place.
    """
    done = basis
    for i in range(min(new.shape[1], new.shape[0] - basis.shape[1])):
        v = new[:, i]
        for _ in range(50):
            size = np.linalg.norm(v)
            for _ in range(2):
                v = v - done @ (done.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size and size > 0:
                v = v / left
                v = v - done @ (done.T @ v)
                done = np.hstack([done, (v / np.linalg.norm(v))[:, None]])
                break
            v = random.normal(size=len(v))
    return done[:, basis.shape[1] :]


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    `n` and the sums S are over all usable rows.  `deviation` is the exact sum
    over the places of (n * x - S)^2, null where no long holds it; `whitened`
    the centred x along the component over the root of its eigenvalue;
    `explained` the eigenvalue over the trace, which the deviations give; and
    `identity_error` the largest entry of the covariance of `whitened` less the
    identity.

    Rows whose vector is null, empty, of an odd length, or holds a null, a
    non-finite entry or one beyond 2^21 are left out; null ids and repeated rows stay and
    count.  Components with an eigenvalue that is zero to rounding are left
    out, so one row, equal rows, or an empty table give an empty table.  Other
    columns are left out.  Runs at once; the driver holds a few blocks of dim x k numbers.
    """
    if k < 1:
        raise ValueError("k must be positive")
    rows = integers(vectors, id_col, vector_col)
    n, sums = moments(rows)
    d = len(sums)
    gap = F.zip_with("x", F.array(*(F.lit(int(s)) for s in sums)), lambda x, s: x * F.lit(n) - s)
    squares = F.aggregate(gap, F.lit(0).cast("decimal(38,0)"), lambda a, g: (a + (g.cast("decimal(19,0)") * g.cast("decimal(19,0)"))).cast("decimal(38,0)"))
    each = rows.withColumn("n", F.lit(n).cast("long")).withColumn("deviation", squares)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if n < 2:
        return vectors.sparkSession.createDataFrame([], schema)
    trace = each.agg(F.sum(F.col("deviation").cast("double"))).first()[0] / float(n) ** 3
    if trace == 0:
        return vectors.sparkSession.createDataFrame([], schema)

    def product(q: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ q)

        return total(rows, add, q.size).reshape(q.shape) / n

    values, axes = components(product, d, k, seed)
    real = values > NOTHING * trace
    values, axes = values[real], axes[:, real]
    m = len(values)
    over = axes / np.sqrt(values)

    def gram(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ over
        return np.vstack([w.T @ w, w.sum(axis=0)])

    found = total(rows, gram, (m + 1) * m).reshape(m + 1, m) / n
    error = float(np.abs(found[:m] - np.outer(found[m], found[m]) - np.eye(m)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w = centred(block(b.column(0)), n, sums) @ over
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * m), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([lists, *b.columns[1:]], names=["w", *b.schema.names[1:]])

    kept = each.select("x", "vec_id", "n", F.expr("try_cast(deviation AS bigint)").alias("deviation"))
    done = kept.mapInArrow(project, f"w array<double>, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields[1:])}")
    shares = F.array(*(F.lit(float(v / trace)) for v in values))
    return done.select("vec_id", "n", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")
    )
