"""Near copies: SimHash links completed to an exact similarity of word shingles.

A text is the set of its shingles; two texts are linked when the sets' Jaccard
similarity reaches a threshold.  Fingerprints near each other, found by
SimHash's pivot tables, are the first candidates, but at a similarity of 0.8
fingerprints lie some ten bits apart, further than any radius that can be
searched.  The rest comes from prefixes: in one fixed order of all shingles, two
such sets share one of their first `n - ceil(threshold * n) + 1` shingles.
Shingles that a sample of the texts repeats come last in that order, which
keeps common passages out of the prefixes; the sample sways the cost, never
the result.

Texts that share a shingle of their prefixes are a cell, and shingles shared by
the same texts are one cell.  While cells hold more than a fixed number of pairs
a text that no link joins yet, every cell compares
its texts with one hub only, in later rounds the text with most links; so a
large group of copies is joined at a cost near its size.  What no link has
joined then is compared pair by pair, where the pairs arise: by sketches, the
shingles' hashes folded to a thousand bits.  A bit that one side alone has is a
shingle that the other lacks, which bounds the similarity from above, so only
pairs that may reach it are moved.  Bitmaps as long as the sets ask, and then
the sets themselves, decide on those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.llm import simhash
from patternloom.llm.common import cut, require, set_aside
from patternloom.llm.components import connected_components

SEED = 42
#: One text in so many is sampled for common shingles; the most shingles that count as common.
SAMPLE, COMMON = 8, 1_000_000
#: Bytes of ids, and of bitmaps, up to which they are broadcast.
BROADCAST_BYTES, BITMAP_BYTES = 64 << 20, 16 << 20
#: Open pairs for each text up to which they are compared one by one, and the most rounds of hubs before that.
OPEN_PAIRS, HUB_ROUNDS = 64, 6
#: 64-bit words of a sketch.
WORDS = 16
#: Texts up to which a cell is compared with the others as a whole; least cells of a text by which its pairs are told to be known.
MEMBERS, LEAST = 64, 12


def shingles(text: str | None, n_words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; up to `n_words` words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n_words:
        return np.array([digest(line, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-n_words]]
    return np.unique(np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[n_words - 1 :], strict=True)], dtype=np.uint64))


def bitmap(s: np.ndarray) -> bytes:
    """Bits of the shingles' hashes modulo four times the next power of two of their number, at least 64."""
    size = max(64, 4 << (len(s) - 1).bit_length()) if len(s) else 64
    bits = np.zeros(size, dtype=np.uint8)
    bits[(s % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def sketch(s: np.ndarray) -> np.ndarray:
    """Bits of the shingles' hashes modulo the bits of a sketch, as signed words."""
    bits = np.zeros(64 * WORDS, dtype=np.uint8)
    bits[(s >> np.uint64(32)) % np.uint64(64 * WORDS)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def bound(x: bytes, y: bytes, m: int, n: int) -> float:
    """An upper bound of the similarity of sets of `m` and `n` shingles by their bitmaps; the longer one is folded."""
    a, b = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    both = min(m - int(np.bitwise_count(a & ~b).sum()), n - int(np.bitwise_count(b & ~a).sum()))
    return both / (m + n - both)


def mapped(texts: DataFrame, n_words: int, pick, with_bits: bool = False) -> DataFrame:
    """(v, n, s, bits, w): of every row (v, text) the number of its shingles, those that `pick` takes, and their bitmap and sketch or nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, n_words) for t in b.column(1).to_pylist()]
            taken = pa.array([pick(s).view(np.int64) for s in sets], type=pa.list_(pa.int64()))
            bits = pa.array([bitmap(s) if with_bits else None for s in sets], type=pa.binary())
            words = pa.array([sketch(s) if with_bits else None for s in sets], type=pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], type=pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, taken, bits, words], names=["v", "n", "s", "bits", "w"])

    return texts.select("v", "text").mapInArrow(run, "v long, n int, s array<long>, bits binary, w array<long>")


def common(texts: DataFrame, n_words: int) -> np.ndarray:
    """Shingles that several texts of a sample have, the rarest first."""
    sample = texts.where(F.pmod(F.xxhash64("v"), F.lit(SAMPLE)) == 0).dropDuplicates(["v"])
    rows = mapped(sample, n_words, lambda s: s).select(F.explode("s").alias("t")).groupBy("t").count().where("count > 1")
    found = rows.orderBy(F.desc("count"), "t").limit(COMMON).select("t").toPandas()
    return found["t"].to_numpy()[::-1].astype(np.int64).view(np.uint64)


def cells(texts: DataFrame, n_words: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(v, n, bits, w) of the distinct texts, and (t, v) of them by the shingles t that several prefixes share."""
    late = common(texts, n_words)
    by_value = np.argsort(late)
    late_sorted = late[by_value]

    def prefix(s: np.ndarray) -> np.ndarray:
        rank = np.full(len(s), -1)
        if len(late_sorted):
            at = np.minimum(np.searchsorted(late_sorted, s), len(late_sorted) - 1)
            rank = np.where(late_sorted[at] == s, by_value[at], -1)
        order = np.argsort(rank, kind="stable")  # s is sorted, so ties stay in the order of hashes
        return s[order][: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1]

    rows = cut(mapped(texts, n_words, prefix, with_bits=True).dropDuplicates(["v"]))
    tokens = rows.select("v", F.explode("s").alias("t"))
    shared = cut(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("t"))
    held = tokens.join(_bounded(shared, shared.count()), "t", "left_semi").select("t", "v")
    return rows.select("v", "n", "bits", "w"), cut(_different(held))


def _different(cells: DataFrame) -> DataFrame:
    """`cells` (t, v) with one cell, of least t, for all that hold the same texts; cells of more than MEMBERS texts stay as they are."""
    sized = cells.withColumn("m", F.count(F.lit(1)).over(W.partitionBy("t")))
    whole = sized.where(F.col("m") <= MEMBERS).groupBy("t").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    return whole.groupBy("vs").agg(F.min("t").alias("t")).select("t", F.explode("vs").alias("v")).unionByName(sized.where(F.col("m") > MEMBERS).select("t", "v"))


def near_prints(texts: DataFrame, n_words: int) -> DataFrame:
    """(src, dst) texts v of equal fingerprints, or of fingerprints that SimHash links."""
    prints = cut(simhash.fingerprints(texts, "v", "text", n_words).distinct())
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("v"))
    equal = prints.join(first, "fp").select(F.col("doc_id").alias("src"), F.col("v").alias("dst"))
    near = simhash.links(first.select("fp")).toDF("a", "b")
    near = near.join(first.toDF("a", "src"), "a").join(first.toDF("b", "dst"), "b").select("src", "dst")
    return equal.where("src != dst").union(near)


def _bounded(ids: DataFrame, n: int) -> DataFrame:
    """`ids`, marked for broadcast while their number of rows allows it."""
    return F.broadcast(ids) if 32 * n <= BROADCAST_BYTES else ids


def links(texts: DataFrame, n_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """(src, dst) links that join the texts (v long, text) as all pairs of a similarity of `threshold` or more would."""
    known, shared = cells(texts, n_words, threshold)
    n_texts, n_bytes = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("bits") + 32), F.lit(0))).first()
    facts = known.select("v", "n", "bits")
    facts = F.broadcast(facts) if n_bytes <= BITMAP_BYTES else facts
    sketches = known.select("v", "n", *(F.col("w")[i].alias(f"w{i}") for i in range(WORDS)))
    small = n_texts * (8 * WORDS + 32) <= BITMAP_BYTES

    def sketched(rows: DataFrame, v: str, mark: str) -> DataFrame:
        """`rows` (t, ...), dealt by t, with the size and the sketch of their text `v`, named after `mark`."""
        of = sketches.toDF(v, f"{mark}n", *(f"{mark}{i}" for i in range(WORDS)))
        # a broadcast after the exchange keeps the sketches out of it
        return rows.repartition("t").join(F.broadcast(of), v) if small else rows.join(of, v)

    def alike(x: str, y: str) -> Column:
        """Whether what x has in its sketch and y has not leaves x enough shingles to share."""
        alone = sum((F.bit_count(F.col(f"{x}{i}").bitwiseAND(F.bitwise_not(F.col(f"{y}{i}")))) for i in range(WORDS)), F.lit(0))
        return F.col(f"{x}n") - alone >= F.lit(threshold / (1 + threshold)) * (F.col("xn") + F.col("yn")) - 1e-9

    def likely_rest(named: DataFrame) -> DataFrame:
        """The distinct pairs (src, dst) of `named` (t, v, c, main) that share t, are of two components, and are alike by their sketches.

        One text of a pair lies outside its cell's largest component `main`, so
        no more pairs are formed than twice those that are open.  A pair is left
        to the least cell that both texts share, where that is among the first
        LEAST cells of both: copies with changes share nearly all of their cells.
        """
        ranked = named.withColumn("at", F.row_number().over(W.partitionBy("v").orderBy("t"))).where(F.col("at") <= LEAST)
        first = cut(ranked.groupBy("v").agg(F.collect_list("t").alias("ts")))
        a = sketched(named.where("c != main").select("t", F.col("v").alias("src"), "c").join(first.toDF("src", "xt"), "src"), "src", "x")
        b = sketched(named.select("t", F.col("v").alias("dst"), F.col("c").alias("hc"), "main").join(first.toDF("dst", "yt"), "dst"), "dst", "y")
        new = F.coalesce(F.array_min(F.array_intersect("xt", "yt")) >= F.col("t"), F.lit(True))
        open_ = (F.col("c") != F.col("hc")) & ((F.col("hc") == F.col("main")) | (F.col("src") < F.col("dst")))
        fit = F.least("xn", "yn") >= F.lit(threshold) * F.greatest("xn", "yn") - 1e-9
        return a.join(b, "t").where(open_ & fit & alike("x", "y") & alike("y", "x") & new).select("src", "dst")

    def likely(pairs: DataFrame) -> DataFrame:
        """The distinct unordered pairs (src, dst) whose sizes and bitmaps allow the similarity, with that bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m, n, x, y = (b.column(c).to_pylist() for c in ("m", "n", "x", "y"))
                yield pa.RecordBatch.from_arrays([b.column("src"), b.column("dst"), pa.array(map(bound, x, y, m, n), pa.float64())], names=["src", "dst", "most"])

        once = pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
        some = facts
        if n_bytes > BITMAP_BYTES:  # the bitmaps are moved of those texts only that are an end of a pair
            once = cut(once)
            ends = once.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
            some = facts.join(_bounded(ends, n_texts), "v", "left_semi")
        sized = once.join(some.toDF("src", "m", "x"), "src").join(some.toDF("dst", "n", "y"), "dst")
        fit = F.least("m", "n") >= F.lit(threshold) * F.greatest("m", "n") - 1e-9
        return sized.where(fit).mapInArrow(run, "src long, dst long, most double").where(F.col("most") >= threshold - 1e-9)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` that have the similarity; only their texts are cut into shingles again."""
        ends = cut(pairs.select(F.explode(F.array("src", "dst")).alias("v")).distinct())
        some = texts.join(_bounded(ends, n_texts), "v", "left_semi").dropDuplicates(["v"])
        sets = mapped(some, n_words, lambda s: s).select("v", "s")
        both = pairs.join(sets.toDF("src", "x"), "src").join(sets.toDF("dst", "y"), "dst")
        same = F.size(F.array_intersect("x", "y"))
        return cut(both.where(same >= F.lit(threshold) * (F.size("x") + F.size("y") - same) - 1e-9).select("src", "dst"))

    seen = cut(likely(near_prints(texts, n_words)).select("src", "dst"))
    found, before = verified(seen), 0
    for r in range(HUB_ROUNDS + 1):
        group = connected_components(found).toDF("v", "c")
        named = shared.join(group, "v", "left").select("t", "v", F.coalesce("c", "v").alias("c"))
        # a cell's open pairs are all of its pairs less those within a component
        each = named.groupBy("t", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("t")
        open_ = each.agg(F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("q"), F.max_by("c", F.struct("k", "c")).alias("main")).where("k * k > q")
        open_ = cut(open_.select("t", "main", ((F.col("k") * F.col("k") - F.col("q")) / 2).alias("pairs")))
        left = open_.agg(F.sum("pairs")).first()[0] or 0
        named = cut(named.join(open_.select("t", "main"), "t"))
        # components only grow, so a cell without open pairs stays without
        shared = named.select("t", "v")
        # hubs that close few pairs are not worth another round
        if left <= OPEN_PAIRS * n_texts or r == HUB_ROUNDS or (r > 1 and left > 0.9 * before):
            break
        before = left
        degree = found.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("d"))
        best = F.struct(F.coalesce("d", F.lit(0)) if r else F.lit(0), F.xxhash64(F.lit(r // 2), "v"))
        hubs = named.join(degree, "v", "left").groupBy("t").agg(F.max_by(F.struct("v", "c"), best).alias("h"))
        met = named.join(hubs, "t").where(F.col("c") != F.col("h.c")).select(F.col("v").alias("src"), F.col("h.v").alias("dst"))
        near = likely(met).join(seen, ["src", "dst"], "left_anti")
        # of each component the likeliest pair goes first; the others may not be needed any more
        of = near.join(group.toDF("src", "c"), "src", "left").select("src", "dst", "most", F.coalesce("c", "src").alias("c"))
        of = of.join(group.toDF("dst", "hc"), "dst", "left").select("src", "dst", "most", "c", F.coalesce("hc", "dst").alias("hc"))
        each = of.select("src", "dst", "most", F.explode(F.array("c", "hc")).alias("c")).groupBy("c").agg(F.max_by(F.struct("src", "dst"), F.struct("most", "src", "dst")).alias("p"))
        pairs = cut(each.select("p.*").distinct())
        found, seen = cut(found.union(verified(pairs))), cut(seen.union(pairs))
    rest = likely(likely_rest(named)).select("src", "dst")
    return found.union(verified(cut(rest.join(seen, ["src", "dst"], "left_anti"))))


def key(text: Column, salt: int) -> Column:
    """A hash of `text` that stands for it; another one for every `salt`."""
    return F.xxhash64(F.lit(salt), text)


def keyed(rows: DataFrame) -> tuple[DataFrame, int]:
    """The distinct (id, v, copies) of `rows` (id, text), and a salt by which no two different texts have one key v.

    Texts count as different where their lengths or a second hash differ.
    """
    marks = {"length": F.length("text"), "other": F.xxhash64(F.lit("other"), "text")}
    ends = [f(m).alias(f"{e}_{m}") for m in marks for f, e in ((F.min, "least"), (F.max, "most"))]
    for salt in count():
        named = rows.select("id", key(F.col("text"), salt).alias("v"), *(c.alias(m) for m, c in marks.items()))
        counted = cut(named.groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"), *ends))
        of = counted.groupBy("v").agg(*(f(f"{e}_{m}").alias(f"{e}_{m}") for m in marks for f, e in ((F.min, "least"), (F.max, "most"))))
        if of.where(" or ".join(f"least_{m} != most_{m}" for m in marks)).isEmpty():
            return counted.select("id", "v", "copies"), salt


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of every group of linked texts: that of the least id, null after all others.

    Rows are told apart by id and text, and of repeated rows one stays.  Null
    texts count as empty.  Columns are those of `docs`.
    """
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted, salt = keyed(docs.select(F.col(id_col).alias("id"), text.alias("text")))
    n_rows, most = counted.agg(F.count(F.lit(1)), F.max("copies")).first()
    groups = connected_components(links(docs.select(key(text, salt).alias("v"), text.alias("text")), n_words, threshold))
    named = counted.join(groups.withColumnRenamed("vertex", "v"), "v", "left").withColumn("component", F.coalesce("component", "v"))
    first = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "v")).alias("f")).select(F.col("f.id").alias("_id"), F.col("f.v").alias("_first"))
    bare, back = set_aside(docs, id_col, text_col)
    same = (F.col("_v") == F.col("_first")) & F.col(id_col).eqNullSafe(F.col("_id"))
    kept = bare.withColumn("_v", key(text, salt)).join(_bounded(cut(first), n_rows), same, "left_semi")
    # without repeated rows there is nothing left to drop, and no need to move the texts
    return back(kept.dropDuplicates([id_col, "_v"]) if (most or 0) > 1 else kept)
