"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one and hashed by several tables of Gaussian
projections cut into cells.  A query visits its own bucket in every table and
then perturbed buckets, in the order in which they are expected to hold near
vectors; the tables' candidates are merged and ranked by exact cosine.

The rows are dealt out to shards by their content, each with its own tables
over its rows, and the stated queries meet every shard in blocks.  Equal
vectors are one entry that keeps the smallest ids, as many as an answer can
need, so a vector that fills a third of the table costs as much as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import cut, pieces, require

TABLES, PROJECTIONS, WIDTH, PROBES = 14, 10, 1.8, 1500
SHARD_ROWS, BLOCK_QUERIES = 10_000, 20_000


@lru_cache
def perturbations(n: int, probes: int) -> np.ndarray:
    """The first `probes` sets of boundary ranks by expected squared distance, as a 0/1 matrix over ranks 1..2n.

    Rank j stands for the j-th nearest of a query's 2n cell boundaries; a set
    that crosses both boundaries of one cell is left out.
    """
    j = np.arange(1, n + 1)
    low = j * (j + 1) / (4 * (n + 1) * (n + 2))
    r = 2 * n + 1 - np.arange(n + 1, 2 * n + 1)
    cost = np.concatenate([low, 1 - r / (n + 1) + r * (r + 1) / (4 * (n + 1) * (n + 2))])
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < probes:
        score, chosen = heappop(heap)
        if not any(2 * n - 1 - c in chosen for c in chosen):
            found.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * n:
            heappush(heap, (score - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heappush(heap, (score + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(found), 2 * n), dtype=np.int64)
    for i, chosen in enumerate(found):
        out[i, list(chosen)] = 1
    return out


class Index:
    """Hash tables over the rows of one shard; `vectors` have length one."""

    def __init__(self, vectors: np.ndarray, tables: int, projections: int, width: float, seed: int = 42) -> None:
        r = np.random.default_rng([seed, vectors.shape[1]])
        self.vectors, self.width = vectors, width
        self.lines = r.standard_normal((tables, vectors.shape[1], projections))
        self.shifts = r.uniform(0, width, (tables, projections))
        self.mix = r.integers(1, 1 << 62, projections, dtype=np.int64) | 1
        self.sorted = []
        for line, shift in zip(self.lines, self.shifts, strict=True):
            code = np.floor((vectors @ line + shift) / width).astype(np.int64) @ self.mix
            order = np.argsort(code, kind="stable")
            self.sorted.append((code[order], order))

    def candidates(self, query: np.ndarray, probes: int) -> np.ndarray:
        """The rows in the buckets that `query` visits, merged over all tables."""
        hit = np.zeros(len(self.vectors), dtype=bool)
        for line, shift, (codes, order) in zip(self.lines, self.shifts, self.sorted, strict=True):
            at = (query @ line + shift) / self.width
            cell = np.floor(at).astype(np.int64)
            gap = at - cell
            boundary = np.concatenate([gap, 1 - gap])
            # what crossing each boundary adds to the code, in order of nearness
            change = np.concatenate([-self.mix, self.mix])[np.argsort(boundary, kind="stable")]
            visited = cell @ self.mix + perturbations(len(cell), probes) @ change
            first, last = np.searchsorted(codes, visited, "left"), np.searchsorted(codes, visited, "right")
            held = np.flatnonzero(last > first)
            lengths = last[held] - first[held]
            ends = np.cumsum(lengths)
            if len(ends):
                hit[order[np.arange(ends[-1]) + np.repeat(first[held] - ends + lengths, lengths)]] = True
        return np.flatnonzero(hit)


def _packed(rows: DataFrame, keep: int) -> DataFrame:
    """(vec binary, ids array<long>): each distinct usable vector as doubles, with its `keep` smallest ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[bytes, list[int]] = {}
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or any(x is None for x in v):
                    continue
                x = np.asarray(v, dtype=np.float64) + 0.0  # no negative zero
                if np.isfinite(x).all() and x.any():
                    by.setdefault(x.tobytes(), []).append(i)
            ids = [sorted(set(x))[:keep] for x in by.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["vec", "ids"])

    local = rows.mapInArrow(pack, "vec binary, ids array<long>")
    return local.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    probes: int = PROBES,
) -> DataFrame:
    """The `k` nearest rows found for each row of `queries`, its own id left out.

    Nearness is the cosine in double precision, the larger the nearer, ties to
    the smaller id.  Returns (query_id, rank from 1, vec_id, score).  A shard in
    which a query's buckets hold too few rows is scanned whole, so a query gets
    `k` answers wherever there are as many.

    Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part; rows that repeat an id with another
    vector are apart, those with the same vector one; vectors of another length
    never meet.  Extra columns are left out; empty tables give an empty table.
    """
    require(vectors, id_col, vec_col)
    require(queries, id_col, vec_col)
    keep = k + 1
    pair = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    entries = cut(_packed(pair(vectors), keep))
    asked = cut(_packed_queries(pair(queries)))
    unique = asked.select("vec").distinct()
    shards, blocks = pieces(entries.count(), SHARD_ROWS), pieces(unique.count(), BLOCK_QUERIES)
    own = lambda n: F.pmod(F.xxhash64("vec"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = entries.select(own(shards).alias("shard"), every(blocks).alias("block"), "vec", "ids")
    right = unique.select(every(shards).alias("shard"), own(blocks).alias("block"), "vec")

    def meet(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[bytes, list[float], list[int]]] = []
        for size, group in asks.groupby(asks["vec"].map(len)):
            same = rows[rows["vec"].map(len) == size]
            if same.empty:
                continue
            raw = np.frombuffer(b"".join(same["vec"]), dtype=np.float64).reshape(len(same), -1)
            norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
            ids = same["ids"].to_numpy()
            index = Index(raw / norm[:, None], tables, projections, width)
            for vec in group["vec"]:
                q = np.frombuffer(vec, dtype=np.float64)
                length = np.sqrt(q @ q)
                at = index.candidates(q / length, probes)
                if len(at) < keep:
                    at = np.arange(len(raw))
                score = np.einsum("ij,j->i", raw[at], q) / (norm[at] * length)
                if len(at) > keep:
                    near = score >= np.partition(score, -keep)[-keep]
                    at, score = at[near], score[near]
                found = sorted((-s, i) for s, r in zip(score.tolist(), at.tolist(), strict=True) for i in ids[r])[:keep]
                out.append((vec, [-s for s, _ in found], [i for _, i in found]))
        return pd.DataFrame(out, columns=["vec", "scores", "ids"])

    answers = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(meet, "vec binary, scores array<double>, ids array<long>")
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("far"), F.col("ids").alias("id"))
    best = answers.select("vec", pairs.alias("p")).groupBy("vec").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, keep).alias("p"))
    per_query = asked.join(best, "vec").select("query_id", F.slice(F.filter("p", lambda x: x["id"] != F.col("query_id")), 1, k).alias("p"))
    return per_query.select("query_id", F.posexplode("p").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )


def _packed_queries(rows: DataFrame) -> DataFrame:
    """(query_id, vec binary) of the usable queries, each pair once."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is None or not v or any(x is None for x in v):
                    continue
                x = np.asarray(v, dtype=np.float64) + 0.0
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    vecs.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], names=["query_id", "vec"])

    return rows.mapInArrow(pack, "query_id long, vec binary").distinct()
