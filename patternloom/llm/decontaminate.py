"""Benchmark decontamination by a broadcast hash set of test n-grams, in DataFrame functions only.

One pass reads the texts.  It cuts a text into words, hashes every word once and
combines the word hashes of each window; windows whose bit is not set in a
small broadcast bitmap of the set go at once.  The few that are left carry
their words, which meet the n-grams themselves in the hash set, so a hit is
verified word by word without a second look at the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import UPPER, cut, require, set_aside

#: Runs of ASCII letters, digits and everything beyond ASCII, A-Z not yet lower-cased.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
#: Bytes of n-grams, or of ids of found documents, up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Bits of the bitmap: 16 for each n-gram, within these bounds (a fuller bitmap costs time, never a hit).
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 20


def lowered(word: Column) -> Column:
    """A-Z of a word lower-cased and nothing else."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, UPPER.lower()))


def raw_words(text: Column) -> Column:
    """The words of a text as they stand; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text: A-Z lower-cased, runs of ASCII letters, digits and everything beyond ASCII."""
    return F.transform(raw_words(text), lowered)


def windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each distinct n-gram of the items: (code long, gram array<string>, item_ids array<string>).

    An item of fewer than `n` words, but not none, is one window of its own
    length.  An item without an id counts, under no name.
    """
    require(items, id_col, text_col)
    split = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.lit(n - 1)))
    grams = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, n))).alias("gram"))
    sets = grams.groupBy("gram").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return sets.select(F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))).alias("code"), "gram", "item_ids")


def bitmap(grams: DataFrame, n_bits: int) -> DataFrame:
    """One row (bits array<long>) of `n_bits` bits, a power of two; bit `code mod n_bits` is set for every code of `grams`."""
    slot = F.shiftright(F.pmod("code", F.lit(n_bits)), 6).cast("int")
    slots = grams.select(slot.alias("slot"), F.expr("shiftleft(1L, cast(pmod(code, 64) as int))").alias("bit"))
    empty = grams.sparkSession.range(n_bits // 64).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("bit"))
    full = slots.unionByName(empty).groupBy("slot").agg(F.bit_or("bit").alias("bit"))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bit"))), lambda s: s["bit"]).alias("bits"))


def hits(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct (id, text) of `docs`: its words, and the windows of `items` in it.

    Returns (doc_id, text_code long, copies long, n_words long, hits
    array<struct<at int, size int>>, item_ids array<string>): `at` counts words
    from 1, `copies` the rows of that id and text, `item_ids` is sorted.  Null
    and empty texts have no words and no hits; null ids are kept; an empty
    `docs` gives an empty table, an empty `items` no hits; extra columns are
    left out.
    """
    require(docs, id_col, text_col)
    grams = windows(items, n)
    facts = grams.agg(F.collect_set(F.size("gram")), F.sum(F.length(F.array_join("gram", " ")) + 64), F.count(F.lit(1))).first()
    sizes, n_bytes = sorted(facts[0]) or [n], facts[1] or 0
    n_bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * facts[2]).bit_length()))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut_up = texts.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_code"), raw_words(F.col("text")).alias("w"))
    hashed = cut_up.select("*", F.transform("w", lambda x: F.xxhash64(lowered(x))).alias("h")).crossJoin(F.broadcast(bitmap(grams, n_bits)))

    def is_set(code: Column) -> Column:
        slot = F.shiftright(F.pmod(code, F.lit(n_bits)), 6).cast("int")
        return F.getbit(F.get("bits", slot), F.pmod(code, F.lit(64)).cast("int")) == 1

    def places(size: int) -> Column:
        last = F.size("w") - F.lit(size - 1)
        near = F.filter(F.sequence(F.lit(1), last), lambda i: is_set(F.xxhash64(F.slice("h", i, size))))
        return F.when(last >= 1, F.transform(near, lambda i: F.struct(i.alias("at"), F.slice("w", i, size).alias("w")))).otherwise(none)

    none = F.array().cast("array<struct<at:int,w:array<string>>>")
    # place 0 stands for the text itself, so that texts without a hit keep a row; an outer explode adds no filter that would cut the text again
    itself = F.array(F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("w")))
    each = hashed.select("doc_id", "text_code", F.size("w").cast("long").alias("n_words"), F.concat(itself, *map(places, sizes)).alias("p"))
    each = each.select("doc_id", "text_code", "n_words", F.explode_outer("p").alias("p"))
    each = each.select("doc_id", "text_code", "n_words", F.col("p.at").alias("at"), F.transform("p.w", lowered).alias("w"))
    # the text itself meets nothing; its code only spreads such rows
    code = F.when(F.col("at") > 0, F.xxhash64(F.transform("w", lambda x: F.xxhash64(x)))).otherwise(F.xxhash64("doc_id", "text_code"))
    each = each.withColumn("c", code)
    met = each.join(F.broadcast(grams) if n_bytes <= BROADCAST_BYTES else grams, (F.col("c") == F.col("code")) & (F.col("w") == F.col("gram")), "left")
    hit = F.col("gram").isNotNull()
    found = met.groupBy("doc_id", "text_code").agg(
        F.count(F.when(F.col("at") == 0, True)).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("at", F.size("gram").alias("size")))).alias("hits"),
        F.collect_set(F.when(hit, F.col("item_ids"))).alias("sets"),
    )
    return found.select("doc_id", "text_code", "copies", "n_words", "hits", F.array_sort(F.array_distinct(F.flatten("sets"))).alias("item_ids"))


def covered(found: Column) -> Column:
    """How many words the windows of `found` cover, overlaps once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(acc: Column, h: Column) -> Column:
        end = h["at"] + h["size"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(h["at"], acc["end"])).cast("long")).alias("n"), F.greatest(end, acc["end"]).alias("end")
        )

    return F.aggregate(F.array_sort(found), start, step, lambda acc: acc["n"])


def report(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, text_code, n_words, n_hit, item_ids (sorted as strings), contaminated.

    Rows that repeat an id with the same text give as many equal rows; nulls
    and empty tables as for `hits`.
    """
    found = hits(docs, items, n, id_col, text_col).select(
        "doc_id", "text_code", "copies", "n_words", covered(F.col("hits")).alias("n_hit"), "item_ids", (F.size("hits") > 0).alias("contaminated")
    )
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def _found(docs: DataFrame, items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _code, _hits) of the texts with a hit, written once; marked for broadcast while their counted size allows it."""
    found = hits(docs, items, n, id_col, text_col).where(F.size("hits") > 0)
    found = cut(found.select(F.col("doc_id").alias("_id"), F.col("text_code").alias("_code"), F.col("hits").alias("_hits")))
    size = found.agg(F.sum(F.size("_hits") * 8 + F.coalesce(F.length(F.col("_id").cast("string")), F.lit(0)) + 64)).first()[0] or 0
    return F.broadcast(found) if size <= BROADCAST_BYTES else found


def _same(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> Column:
    return docs[id_col].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == found["_code"])


def drop_documents(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows in which a window of `items` occurs; all columns and other rows stay, repeated and null ones too."""
    found = _found(docs, items, n, id_col, text_col)
    bare, back = set_aside(docs, id_col, text_col)
    return back(bare.join(found, _same(bare, found, id_col, text_col), "left_anti"))


def drop_spans(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every word in a window of `items`, and what follows it up to the next word, cut out of the text.

    Rows without a hit stay as they are: null and empty texts, null ids,
    repeated rows.  An empty `docs` or `items` changes nothing.
    """
    found = _found(docs, items, n, id_col, text_col)
    # every word with the separators after it, behind the separators that open the text
    parts = F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    head = F.regexp_extract(F.col(text_col), r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    gone = F.array_distinct(F.flatten(F.transform("_hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))
    # the parts are bound once per text, not once per word
    kept = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), F.size(p)), gone), lambda i: F.element_at(p, i)), "")), 1)
    text = F.when(F.col("_hits").isNull(), F.col(text_col)).otherwise(F.concat(head, kept))
    bare, back = set_aside(docs, id_col, text_col)
    return back(bare.join(found, _same(bare, found, id_col, text_col), "left").withColumn(text_col, text))
