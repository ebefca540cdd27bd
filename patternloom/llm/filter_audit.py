"""Filter interaction audit: what every filter removes, in every order, from one table of mask counts.

A row's mask has bit i set where filter i fails it.  Per part, the rows, the
sound ones and the toxic ones are counted by mask; a subset-zeta transform of
those 2^n counts gives, for every set of filters, the rows that no filter of
the set fails.  What a step of an order keeps, and what it removes, are then
differences between neighbouring sets, and so are a filter's average shares.
The texts are read once, whatever the number of orders.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import require

SPACE = r"[\x20\x09-\x0D]+"
#: Counts that are kept by mask.
COUNTS = ("n", "good", "toxic")
#: The orders grow as the factorial, and each is as many rows as there are filters.
MOST_FILTERS = 8


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a row fails each filter that looks at its own text only; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(filters: Mapping[str, Column]) -> Column:
    """The mask of `filters`, the first one as the lowest bit."""
    return sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(filters.values())), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): rows of `docs` by part and mask of the filters A to D of `text_filters` and E.

    E fails a row whose text a row of a smaller id has too, anywhere in the
    table.  Texts are told apart by SHA-256.  Rows are first put together by
    (text, id, part), and the least id of each text is found with partial
    sums, so a text with many copies is no hot key; ids without a value are
    smaller than none and larger than none.  `labels` (id, quality, toxic)
    may cover some ids, or one more than once: any 1 counts.

    Null texts count as empty, null parts as the empty string; repeated rows
    count each, and do not fail each other; an empty table gives an empty one;
    other columns are left out.
    """
    require(docs, part, id_col, text_col)
    require(labels, id_col, "quality", "toxic")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), _bits(text_filters(text)).alias("own")
    )
    each = rows.groupBy("key", "id", "part", "own").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where("id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    marked = each.join(first, ["key", "id"], "left")
    # a null id matches nothing; dealt out by its text it gathers nowhere
    salt = F.when(F.col("id").isNull(), F.xxhash64("key")).otherwise(F.lit(0).cast("long"))
    marked = marked.withColumn("salt", salt).join(known.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left")
    late = F.col("id").isNotNull() & F.col("first").isNull()
    mask = F.col("own") + F.when(late, 16).otherwise(0)
    counted = lambda c: F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0))
    return marked.groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), counted("quality").alias("good"), counted("toxic").alias("toxic"))


def zeta(counts: Column, n: int) -> Column:
    """Of an array over the masks of `n` bits: at each mask the sum over all its submasks."""
    for i in range(n):
        bit = 1 << i
        below = lambda a: lambda v, m: v + F.when(m.bitwiseAND(bit) != 0, F.get(a, m.bitwiseXOR(F.lit(bit)))).otherwise(0)
        # named once each round: an array that mentions itself twice in every round would double each time
        counts = F.transform(F.array(counts), lambda a: F.transform(a, below(a)))[0]
    return counts


def survivors(masked: DataFrame, n: int) -> DataFrame:
    """(part, fails, and for each of `COUNTS` an array `kept_<count>`) of `masked` (part, mask, n, good, toxic).

    Entry S of `kept_<count>` counts the rows that no filter of the set S
    fails; `fails` holds the counts of each mask itself.
    """
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    size = 1 << n
    sums = masked.groupBy("part").agg(*(F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in COUNTS))
    every = F.sequence(F.lit(0), F.lit(size - 1))
    filled = lambda c: F.transform(every, lambda m: F.coalesce(F.element_at(F.col(c), m), F.lit(0).cast("long")))
    at = sums.select("part", *(filled(c).alias(c) for c in COUNTS))
    # rows whose mask lies within the complement of S pass every filter of S
    flipped = lambda c: F.reverse(zeta(F.col(c), n))
    return at.select("part", F.col("n").alias("fails"), *(flipped(c).alias(f"kept_{c}") for c in COUNTS))


def orders(masked: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of all `letters` and step of it; see `audit` for the columns."""
    n = len(letters)
    full = (1 << n) - 1
    bits = F.create_map(*(F.lit(v) for i, c in enumerate(letters) for v in (c, 1 << i)))
    every = F.explode(F.array(*(F.array(*map(F.lit, p)) for p in permutations(letters))))
    step = survivors(masked, n).withColumn("names", every).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    set_of = lambda names: F.aggregate(names, F.lit(0), lambda s, c: s + F.element_at(bits, c))
    step = step.withColumn("before", set_of(F.slice("names", F.lit(1), F.col("step") - 1)))
    step = step.withColumn("own", F.element_at(bits, F.element_at("names", F.col("step")))).withColumn("after", F.col("before") + F.col("own"))
    kept = lambda c, s: F.get(f"kept_{c}", s)
    lost = lambda c: kept(c, F.col("before")) - kept(c, F.col("after"))
    failed = kept("n", F.lit(0)) - kept("n", F.col("own"))

    def share(s: Column) -> Column:
        """Of a set without the filter: the orders in which just the set comes before it, times what it then removes."""
        size = F.bit_count(s)
        ways = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size + 1)
        return F.when(s.bitwiseAND(F.col("own")) == 0, ways * (kept("n", s) - kept("n", s + F.col("own")))).otherwise(0).cast("long")

    return step.select(
        "part",
        F.concat_ws("", "names").alias("filter_order"),
        "step",
        kept("n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (failed - lost("n")).alias("redundant"),
        F.get("fails", F.col("own")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(full)), share), F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each part, each of the 120 orders of the filters A to E and each step: what happens there.

    (part, filter_order, step int; longs kept after the step, removed by it,
    redundant: failing its filter but removed before, unique_fails: failing its
    filter only, good_lost and toxic_lost: removed here and labelled so,
    shapley: what its filter removes, summed over all orders).  Odd rows are as
    in `masks`.
    """
    return orders(masks(docs, labels, part, id_col, text_col), "ABCDE")
