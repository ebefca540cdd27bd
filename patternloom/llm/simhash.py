"""SimHash near-duplicate detection with pivot distance tables.

A document becomes a 64-bit fingerprint; fingerprints that differ in at most
`max_bits` bits are linked, and every document gets the least doc_id that it
reaches over links.

How links are found.  Equal fingerprints collapse first.  The 64 bits are then
cut into `max_bits + 2` fields; two fingerprints within `max_bits` bits agree
on at least two fields, so the fingerprints are dealt out by every pair of
fields and only members of one cell meet.  Inside a cell a pivot table holds
each member's Hamming distance to many fixed reference fingerprints: by the
triangle inequality a pair whose coordinates differ by more than `max_bits`
anywhere cannot be linked, so it is discarded before the exact comparison.
A cell passes on a star for each group it finds, never its pairs, and a cell
of many members is cut into chunks that meet two at a time in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import cut, partitions, require
from patternloom.llm.components import connected_components

SEED = 42
N_PIVOTS = 16
CHUNK = 4096


def fingerprint(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned SimHash of one text; a text without words gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: -shingle_words])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle_words - 1 :], strict=True)], dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        counts += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long; null texts count as empty."""
    require(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.fromiter((fingerprint(t, shingle_words) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(digest, f"doc_id {kind.simpleString()}, fp long")


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """`n` fixed reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], dtype=np.uint64)


def stars(members: np.ndarray, max_bits: int, refs: np.ndarray) -> list[tuple[int, int]]:
    """(member, root) links that join the distinct `members` as their links within `max_bits` do."""
    table = np.bitwise_count(members[:, None] ^ refs[None, :]).astype(np.int8)
    open_, found = np.arange(len(members)), []
    while len(open_) > 1:
        root, open_ = open_[0], open_[1:]
        queue = [root]
        while queue and len(open_):
            at = queue.pop()
            near = (np.abs(table[open_] - table[at]) <= max_bits).all(axis=1)
            near[near] = np.bitwise_count(members[open_[near]] ^ members[at]) <= max_bits
            if near.any():
                new = open_[near]
                found += [(int(members[i]), int(members[root])) for i in new]
                queue += new.tolist()
                open_ = open_[~near]
    return found


def links(nodes: DataFrame, max_bits: int = 3, n_pivots: int = N_PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) links that join the distinct fingerprints of `nodes` (fp long) as all links within `max_bits` would."""
    n_fields = max_bits + 2
    edges = [round(64 * i / n_fields) for i in range(n_fields + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    pairs = [signed(masks[i] | masks[j]) for i, j in combinations(range(n_fields), 2)]
    cells = nodes.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in pairs])).alias("tab", "cell")
    )
    sizes = cells.groupBy("tab", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n_chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    met = (
        cells.join(sizes, ["tab", "cell"])
        .withColumn("chunks", n_chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("chunks") - F.lit(1)))))
        .where("chunks = 1 or own != other")
        .select("fp", F.xxhash64("tab", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("task"))
    )
    parts = partitions(nodes.sparkSession) * 4
    refs = pivots(n_pivots)

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["task"].to_numpy(), kind="stable")
        task, fp = frame["task"].to_numpy()[order], frame["fp"].to_numpy()[order].view(np.uint64)
        cuts = np.flatnonzero(np.diff(task)) + 1
        found = [e for part in np.split(fp, cuts) if len(part) > 1 for e in stars(np.unique(part), max_bits, refs)]
        out = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"src": out[:, 0], "dst": out[:, 1]})

    return (
        met.withColumn("part", F.pmod("task", F.lit(parts)))
        .groupBy("part")
        .applyInPandas(within, "src long, dst long")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, max_bits: int = 3, n_pivots: int = N_PIVOTS
) -> DataFrame:
    """Fingerprint and component of every row: (doc_id, fp long, component_id).

    Texts: null and empty texts have the fingerprint 0 and link like any other.
    A null id is kept and never represents a group unless all ids in it are
    null.  Repeated rows give repeated rows.  An empty table gives an empty
    table; other columns are ignored, whatever their names.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(links(nodes.select("fp"), max_bits, n_pivots))
    labelled = nodes.join(groups.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    names = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")
