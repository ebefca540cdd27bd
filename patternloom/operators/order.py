"""Places, running sums and quantiles in an order of all rows, without one task that sorts them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from patternloom.operators.iterate import settle

#: Rows sampled for each range.
SAMPLE = 32


def ranked(df: DataFrame, *order: str, weight: str | None = None, into: str = "rn") -> DataFrame:
    """`df` with `into`, the rows that come before in the order of the columns `order`, nulls first; with `weight`, their sum of it.

    A sample gives bounds, which are collected once, so the range of a row is
    a function of its values and not of where it lies.  A row's place is its
    place in its range plus all rows of the ranges before.  Rows equal in all
    of `order` follow each other in any order.  Runs two small jobs at once.
    """
    if not order:
        raise ValueError("no columns to order by")
    spark = df.sparkSession
    key = F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    ranges, n = int(spark.conf.get("spark.sql.shuffle.partitions")), df.count()
    some = df.select(key.alias("k"))
    sample = [r["k"] for r in some.sample(min(1.0, SAMPLE * ranges / max(n, 1)), 0).orderBy("k").collect()]
    bounds = [sample[i] for i in range(SAMPLE, len(sample), max(1, len(sample) // ranges))]
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)] or [[]]
    kind = T.ArrayType(some.schema["k"].dataType)
    table = spark.createDataFrame([([b[0] for b in blocks[1:]], blocks)], T.StructType([T.StructField("_heads", kind), T.StructField("_blocks", T.ArrayType(kind))]))
    names = df.columns
    # first the block, then the place in it: two short scans instead of one over all bounds
    block = df.crossJoin(F.broadcast(table)).withColumn("_block", F.size(F.filter("_heads", lambda b: b <= key)))
    inside = F.size(F.filter(F.get("_blocks", F.col("_block")), lambda b: b <= key))
    parts = block.select(*names, (F.col("_block") * width + inside).alias("_range"))
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = parts.groupBy("_range").agg(size.alias("_n"))
    over = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # over one row for each range
    before = counted.select("_range", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    within = W.partitionBy("_range").orderBy(*order)
    place = F.row_number().over(within) - 1 if weight is None else F.coalesce(F.sum(weight).over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("_at", place).join(F.broadcast(before), "_range")
    return placed.select(*names, (F.col("_at") + F.col("_before")).cast("long").alias(into))


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """One row: under the name of each of `columns` the array of its quantiles `qs`, interpolated between neighbours.

    Nulls are left out; a column without values has nulls.  Exact: equal values
    are counted before anything is shuffled or put in order, so neither many
    rows nor a value that most of them share meet in one task, and a quantile
    is a lookup of two places among the counts.
    """
    each = F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)))
    long = df.select(F.explode(each).alias("s")).select("s.*").where("v is not null")
    counts = settle(long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    count = {r["c"]: r["n"] for r in counts.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    first, found, wanted = 0, [], set()
    for i, c in enumerate(columns):
        n, values = count.get(i, 0), []
        for q in qs:
            at = q * (n - 1)
            low, high = first + math.floor(at), first + math.ceil(at)
            wanted |= {low, high} if n else set()
            value = lambda r: F.element_at("m", F.lit(r).cast("long"))
            values.append(value(low) + (value(high) - value(low)) * (at - math.floor(at)) if n else F.lit(None).cast("double"))
        found.append(F.array(*values).alias(c))
        first += n
    places = F.array(*(F.lit(w).cast("long") for w in sorted(wanted)))
    inside = F.filter(places, lambda w: (w >= F.col("rn")) & (w < F.col("rn") + F.col("n")))
    picked = ranked(counts, "c", "v", weight="n").select(F.explode(inside).alias("rn"), "v")
    return picked.agg(F.map_from_entries(F.collect_list(F.struct("rn", "v"))).alias("m")).select(*found)
