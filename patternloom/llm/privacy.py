"""Personal data: base patterns, and the words of the corpus that give them away.

Each value that a base pattern finds is a protected entity.  Over all documents
it is counted how often a word stands near an entity, and how often the word and
the entity occur at all.  Of the information that naming the entity would carry,
IC(e) = -ln p(e), a word discloses the share PMI(e; t) / IC(e), which is 1 when
the word occurs with the entity alone and 0 when it says nothing.  A word whose
share for any entity reaches the threshold is a span too, wherever it stands.
It is generalised to its class (a number, a name, ...) as long as the class
itself discloses less than the threshold of each of those entities, and removed
otherwise.

The texts are read three times: for entities and the words near them, for the
counts of those words in all documents, and for the places of the words to
sanitise.  The second and third time a bitmap of fixed size tells most other
words apart inside the tasks; joins on the words themselves settle the rest.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import cut, require

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[^\W_]{2,}")
#: Words on either side of an entity that count as near it.
WINDOW = 8
#: Documents in which a word must stand near an entity before the two are judged; fewer estimate nothing.
SUPPORT = 3
THRESHOLD = 0.9
#: Marks a class in tables of words; no word holds it.
CLASS = "~"
#: Bits of the bitmap: 4 MB, whatever the number of words.
BITS = 1 << 25
#: Words that a task counts before it hands the counts on, and that it remembers.
HELD = 200_000
#: Longer words and entities go by their digest.
LONGEST = 64


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses; each stretch before an `@` is looked at once, so a long one costs linear time."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            yield start, done
        at = text.find("@", done)


def dotted(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers with dots between, each at most 255; a longer chain of numbers is cut in fours from its left."""
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns in order of start, then kind: leftmost and apart within a kind, failing ones dropped."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(a, 1, b) for a, b in dotted(text)]
    for m in NUMBER.finditer(text):
        digits = NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


def entity(kind: int, value: str) -> str:
    """The name of a protected value: spaces and signs in numbers, and the case of addresses, do not count."""
    value = value.lower() if kind == 0 else value if kind == 1 else NOT_DIGIT.sub("", value)
    return f"{KINDS[kind]}:{short(value)}"


def short(word: str) -> str:
    return word if len(word) <= LONGEST else hashlib.sha256(word.encode("utf-8", "surrogatepass")).hexdigest()


def word_class(word: str) -> str:
    """What a word is generalised to."""
    if word.isdigit():
        return "number"
    if not word.isalpha():
        return "code"
    return "word" if word.islower() else "capitals" if word.isupper() else "name" if word[1:].islower() else "word"


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The words that no span touches."""
    edges: list[list[int]] = []
    for a, _, b in spans:
        if edges and a <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], b)
        else:
            edges.append([a, b])
    starts = [a for a, _ in edges]
    out = []
    for m in WORD.finditer(text):
        i = bisect_left(starts, m.end()) - 1  # the last stretch that starts before the word ends
        if i < 0 or edges[i][1] <= m.start():
            out.append(m.span())
    return out


def near(text: str, spans: list[tuple[int, int, int]], window: int) -> set[tuple[str, str]]:
    """(entity, term) once each: the entities alone with the term '', the words around them, and the classes of those."""
    words = free_words(text, spans)
    starts, out = [a for a, _ in words], set()
    for a, kind, b in spans:
        name = entity(kind, text[a:b])
        out.add((name, ""))
        at, after = bisect_right(starts, a), bisect_left(starts, b)
        for i, j in words[max(0, at - window) : at] + words[after : after + window]:
            out.add((name, short(text[i:j].lower())))
            out.add((name, CLASS + word_class(text[i:j])))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    require(docs, id_col, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _key(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, key, base array<struct<start, kind, end>>, near array<struct<entity, term>>) of each row; `key` is the SHA-256 of the text."""
    rows = _texts(docs, id_col, text_col)
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    pair = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, base, close = [], [], []
            for text in b.column(1):
                text = text.as_py()
                spans = base_spans(text)
                keys.append(_key(text))
                base.append([{"start": a, "kind": k, "end": e} for a, k, e in spans])
                close.append([{"entity": e, "term": t} for e, t in near(text, spans, window)] if spans else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(base, span), pa.array(close, pair)], names=["doc_id", "key", "base", "near"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, base array<struct<start:int,kind:int,end:int>>, near array<struct<entity:string,term:string>>")


class Bitmap:
    """Which words may be among some: all of those, and few others."""

    def __init__(self, words: DataFrame) -> None:
        """Of the column `term`.  What reaches the driver is `BITS` bits at most."""
        place = F.pmod(F.xxhash64("term"), F.lit(BITS)) + 1
        parts = words.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        self.bits = np.zeros(BITS // 8, dtype=np.uint8)
        for r in parts.collect():
            part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
            at = (r["b"] - 1) * len(part)  # buckets count from 1
            self.bits[at : at + len(part)] = part

    def __contains__(self, word: str) -> bool:
        p = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & (BITS - 1)
        return bool(self.bits[p >> 3] >> (p & 7) & 1)


def _shared_bitmap(words: DataFrame):
    return words.sparkSession.sparkContext.broadcast(Bitmap(words))


class Lookup:
    """The term of a word if the bitmap may hold it, else None; remembers some words."""

    def __init__(self, bitmap: Bitmap) -> None:
        self.bitmap, self.seen = bitmap, {}

    def __getitem__(self, word: str) -> str | None:
        if word not in self.seen:
            if len(self.seen) >= HELD:
                self.seen.clear()
            term = short(word.lower())
            self.seen[word] = term if term in self.bitmap else None
        return self.seen[word]


def document_counts(docs: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): in how many rows of `docs` each of `words` (term), and each class, occurs; other words may be counted too."""
    bitmap = _shared_bitmap(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lookup, kinds = Counter(), Lookup(bitmap.value), {}

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])
            counts.clear()
            return out

        for b in batches:
            for text in b.column(0):
                found = set(WORD.findall(text.as_py()))
                if len(kinds) >= HELD:
                    kinds.clear()
                for w in found:
                    if w not in kinds:
                        kinds[w] = CLASS + word_class(w)
                counts.update({t for w in found if (t := lookup[w]) is not None})
                counts.update({kinds[w] for w in found})
                if len(counts) >= HELD:
                    yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosures(docs: DataFrame, found: DataFrame, support: int = SUPPORT, text_col: str = "text") -> DataFrame:
    """(entity, term, class, n, disclosure) of each pair that `found` (of `entities`) holds in `support` rows or more.

    `class` tells whether the term is a class of words.  Entities in all rows carry no information and have no pairs.
    """
    pairs = cut(found.select(F.explode("near").alias("p")).groupBy("p.entity", "p.term").agg(F.count(F.lit(1)).alias("n")))
    total = found.count()
    whole = pairs.where("term = ''").select("entity", F.col("n").alias("ne"))
    is_class = F.col("term").startswith(CLASS)
    judged = pairs.where("term != ''").where(is_class | (F.col("n") >= support))
    counts = document_counts(docs, judged.where(~is_class).select("term").distinct(), text_col).withColumnRenamed("n", "nt")
    counts = cut(counts)
    share = F.log(F.col("n") * float(total) / F.col("ne") / F.col("nt")) / F.log(float(max(total, 1)) / F.col("ne"))
    # the classes, a handful of terms that stand beside nearly every entity, are no keys to shuffle by
    of_words = judged.where(~is_class).join(counts.where(~is_class), "term")
    of_classes = judged.where(is_class).join(F.broadcast(counts.where(is_class)), "term")
    joined = of_words.unionByName(of_classes).join(whole, "entity").where(F.col("ne") < total)
    return joined.select("entity", "term", is_class.alias("class"), "n", share.alias("disclosure"))


def revealing(judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(term, removed array<string>): the words at or over the threshold for some entity, and the classes that reveal one of those too.

    An occurrence whose class is among `removed` is removed; another is generalised to it.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    over = cut(judged.where(F.col("disclosure") >= threshold - 1e-9))
    words = over.where(~F.col("class")).select("entity", "term")
    classes = over.where("class").select("entity", F.substring("term", 2, 20).alias("kind"))
    return words.join(classes, "entity", "left").groupBy("term").agg(F.collect_set("kind").alias("removed"))


def term_spans(docs: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """(key, terms array<struct<start, kind, end, mark>>): for each text with any of `words` (term, removed), the places no base span touches.

    `mark` is what the place is generalised to, empty where it is removed.
    Copies of a text are one row before anything is exploded or joined.
    """
    bitmap = _shared_bitmap(words)
    place = pa.list_(pa.struct([("term", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(bitmap.value)
        for b in batches:
            keys, places = [], []
            for text in b.column(0):
                text = text.as_py()
                if not any(lookup[w] is not None for w in set(WORD.findall(text))):
                    continue
                hits = [(i, j, t) for i, j in free_words(text, base_spans(text)) if (t := lookup[text[i:j]]) is not None]
                if hits:
                    keys.append(_key(text))
                    places.append([{"term": t, "kind": word_class(text[i:j]), "start": i, "end": j} for i, j, t in hits])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, place)], names=["key", "places"])

    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.mapInArrow(run, "key binary, places array<struct<term:string,kind:string,start:int,end:int>>")
    once = found.groupBy("key").agg(F.first("places").alias("places"))
    each = once.select("key", F.explode("places").alias("p")).select("key", "p.*").join(words, "term")
    mark = F.when(F.array_contains("removed", F.col("kind")), "").otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    return each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(TERM).alias("kind"), "end", mark.alias("mark")))).alias("terms"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, window: int = WINDOW, support: int = SUPPORT) -> DataFrame:
    """(doc_id, base, terms) of every row: the base spans, and the words that disclose a protected entity.

    `base` is an array of (start, kind, end) and `terms` of (start, kind, end,
    mark), both in order of start, then kind; `kind` counts along `KINDS`.
    Offsets are code points, ends exclusive.  Rows are the documents that are
    counted, copies and repeated rows included.  Null texts count as empty,
    null ids are ids; an empty table gives an empty one; other columns are left
    out.  Long texts are read whole, in time linear in their length.
    """
    found = cut(entities(docs, id_col, text_col, window))
    words = cut(revealing(disclosures(docs, found, support, text_col), threshold))
    spans = term_spans(docs, words, text_col)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,mark:string>>")
    return found.join(spans, "key", "left").select("doc_id", "base", F.coalesce("terms", none).alias("terms"))


def scan_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, window: int = WINDOW, support: int = SUPPORT) -> DataFrame:
    """As `scan`, reduced to counts of the kinds, a digest of the base spans and one string of all spans."""
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, id_col, text_col, threshold, window, support).select(
        "doc_id",
        *(counted(k).alias(f"n_{KINDS[k]}") for k in range(TERM)),
        F.sha2(said(F.col("base")), 256).alias("base_sha256"),
        said(F.sort_array(F.concat("base", plain))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, window: int = WINDOW, support: int = SUPPORT) -> DataFrame:
    """`docs` with every base span as the mark of its kind, and every disclosing word generalised or removed.

    Spans that overlap become one mark, that of the first.  Other columns,
    null texts, null ids and repeated rows stay as they are.
    """
    found = cut(entities(docs, id_col, text_col, window))
    words = cut(revealing(disclosures(docs, found, support, text_col), threshold))
    terms = term_spans(docs, words, text_col).select(F.col("key").alias("__key"), F.col("terms").alias("__terms"))
    key = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    joined = docs.withColumn("__key", key).join(terms, "__key", "left").select(*docs.columns, "__terms")
    at, names = docs.columns.index(text_col), docs.columns

    def clean(text: str | None, terms: list[dict] | None) -> str | None:
        if text is None:
            return None
        spans = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in base_spans(text)] + [(t["start"], t["end"], t["mark"]) for t in terms or []]
        out, done = [], 0
        for a, b, mark in sorted(spans, key=lambda s: s[0]):
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            columns[at] = pa.array([clean(t.as_py(), s.as_py()) for t, s in zip(columns[at], b.columns[-1], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)
