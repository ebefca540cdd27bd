"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from patternloom.llm.common import cut, pieces

#: Edges that a task of a round reads; a table of few edges is not dealt out to many tasks.
TASK_EDGES = 20_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every vertex of `edges` (src long, dst long) with the least vertex it reaches.

    Alternates a large-star step (each vertex hands its larger neighbours to
    its least neighbour) with a small-star step until the edges stop changing,
    which takes a logarithmic number of rounds.  Each round is two aggregates
    and joins on vertices and ends in a checkpoint; nothing but one change
    count reaches the driver.  Null ends are dropped; loops and repeated edges
    are harmless; an empty table gives an empty table.

    Returns (vertex long, component long), one row per vertex with an edge to
    another vertex.
    """
    now = cut(_canonical(edges.select("src", "dst")))
    before = _state(now)
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now.coalesce(pieces(before[0], TASK_EDGES)))))
        seen = _state(now)
        if seen == before:
            return now.select(F.col("src").alias("vertex"), F.col("dst").alias("component")).union(
                now.select("dst", "dst").distinct()
            )
        before = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(edges: DataFrame) -> Row:
    """The number of edges and a sum of their hashes."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()


def _canonical(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger end to its smaller one."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = _two(edges, ("src", "dst"), ("dst", "src"))
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return (
        both.where(F.col("dst") > F.col("src"))
        .join(least, "src")
        .select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    return _canonical(_two(edges.join(least, "src"), ("dst", "m"), ("src", "m")))


def _two(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """An edge (src, dst) for each row and each of `pairs` of its columns, in the partitions of `rows`."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in pairs])))
