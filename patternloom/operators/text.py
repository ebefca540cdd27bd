"""Corpora: cleaning, term weights, topic tables and their coherence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.functions import vectors as V
from patternloom.operators.cells import Blocks, gram
from patternloom.operators.iterate import settle
from patternloom.operators.passes import lists, matrix


#: Words that tell nothing about a topic.
STOP_WORDS = tuple(
    "a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down "
    "during each few for from further had has have having he her here hers him his how if in into is it its itself just me more most my no nor not now of "
    "off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with would you your yours".split()
)


def clean(text: Column) -> Column:
    """Lower case, everything but a-z and white space to a space, white space collapsed; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " "))


def tokens(text: Column, least: int = 2) -> Column:
    """The runs of `least` letters or more of the lower-cased text; a null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def terms(text: Column, ngrams: int = 1, stop: tuple[str, ...] = ()) -> Column:
    """The tokens of a text without those in `stop`, and runs of up to `ngrams` of what is left, joined by spaces."""
    if ngrams < 1:
        raise ValueError("ngrams must be positive")
    kept = F.filter(tokens(text), lambda w: ~w.isin(*stop)) if stop else tokens(text)
    if ngrams == 1:
        return kept

    def runs(t: Column) -> Column:
        of = lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.concat(t, *(of(n) for n in range(2, ngrams + 1)))

    # bound once, so that the text is not cut for every run
    return F.element_at(F.transform(F.array(kept), runs), 1)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: DataFrame | None = None, ngrams: int = 1, stop: tuple[str, ...] = ()) -> DataFrame:
    """(doc, term, n) cells; with `vocabulary` (term), of its terms only; terms as in `terms`."""
    # texts go to where their cells are counted, so that cells, which are several times as large, are not moved;
    # an outer explode adds no filter that would cut the text a second time
    each = docs.select(F.col(id_col), F.col(text_col)).repartition(F.col(id_col)).select(F.col(id_col).alias("doc"), F.explode_outer(terms(F.col(text_col), ngrams, stop)).alias("term")).where("term is not null")
    cells = each.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("n"))
    return cells if vocabulary is None else cells.join(vocabulary.select("term").distinct(), "term", "left_semi").select("doc", "term", "n")


def vocabulary(cells: DataFrame, min_df: int = 2, max_df: float = 1.0, n_docs: int | None = None) -> DataFrame:
    """(term, df) of the terms in at least `min_df` documents and at most `max_df` of them."""
    total = cells.agg(F.countDistinct("doc").alias("n_docs")) if n_docs is None else cells.sparkSession.range(1).select(F.lit(n_docs).alias("n_docs"))
    df = cells.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(total)).where(F.col("df") <= max_df * F.col("n_docs")).select("term", "df")


def tfidf(cells: DataFrame, min_df: int = 2, max_df: float = 1.0) -> DataFrame:
    """(doc, term, weight): n * (ln((1 + N) / (1 + df)) + 1), rows scaled to length one."""
    cells = settle(cells)  # read by the total, the vocabulary and the weights
    total = cells.agg(F.countDistinct("doc").alias("n_docs"))
    weighed = cells.join(vocabulary(cells, min_df, max_df), "term").crossJoin(F.broadcast(total)).select("doc", "term", (F.col("n") * (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc")))
    return weighed.select("doc", "term", (F.col("w") / length).alias("weight"))


def topic_terms(components: DataFrame, n_terms: int = 10) -> DataFrame:
    """(topic, rank from 0, term, weight): the heaviest terms of components (topic, term, weight), ties by term."""
    if n_terms < 1:
        raise ValueError("n_terms must be positive")
    rank = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("weight"), "term")) - 1
    return components.withColumn("rank", rank).where(F.col("rank") < n_terms).select("topic", "rank", "term", "weight")


def topic_labels(components: DataFrame, n_terms: int = 3) -> DataFrame:
    """(topic, label), such as `a / b / c`."""
    top = topic_terms(components, n_terms).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("ts"))
    return top.select("topic", F.array_join(F.transform("ts", lambda t: t["term"]), " / ").alias("label"))


def assign_documents(df: DataFrame, weights: str = "weights", id_col: str = "doc") -> DataFrame:
    """(doc, topic, confidence): the first topic of greatest weight, and its share, 0 where the sum is not positive."""
    total = V.total(F.col(weights))
    return df.select(
        F.col(id_col).alias("doc"), (F.array_position(weights, F.array_max(weights)) - 1).cast("int").alias("topic"), F.when(total > 0, F.array_max(weights) / total).otherwise(0.0).alias("confidence")
    )


def umass_coherence(top: DataFrame, cells: DataFrame, epsilon: float = 1.0) -> DataFrame:
    """(topic, coherence): the mean of ln((D(i, j) + epsilon) / D(i)) over pairs of ranks i < j; null with fewer than two known terms."""
    df = cells.groupBy("term").agg(F.count(F.lit(1)).alias("d"))
    known = top.join(df, "term").select("topic", "rank", "term", "d")
    a = known.toDF("topic", "ri", "ti", "di")
    b = known.select("topic", F.col("rank").alias("rj"), F.col("term").alias("tj"))
    pairs = a.join(b, "topic").where("ri < rj")
    wanted = cells.join(known.select("term").distinct(), "term", "left_semi").select("doc", "term")
    together = wanted.toDF("doc", "ti").join(wanted.toDF("doc", "tj"), "doc").where("ti != tj").groupBy("ti", "tj").agg(F.count(F.lit(1)).alias("dij"))
    scored = pairs.join(together, ["ti", "tj"], "left").select("topic", F.log((F.coalesce("dij", F.lit(0)) + epsilon) / F.col("di")).alias("s"))
    return top.select("topic").distinct().join(scored.groupBy("topic").agg(F.avg("s").alias("coherence")), "topic", "left")


def topic_diversity(top: DataFrame) -> DataFrame:
    return top.agg((F.countDistinct("term") / F.count(F.lit(1))).alias("diversity"))


def known_terms(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_known): how many distinct terms of the vocabulary each document has, 0 included."""
    cells = counts(docs, id_col, text_col, vocabulary).groupBy("doc").agg(F.count(F.lit(1)).alias("n_known"))
    return docs.select(F.col(id_col).alias("doc")).join(cells, "doc", "left").na.fill(0, ["n_known"])


def truncated(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), F.array_join(F.slice(F.split(clean(F.col(text_col)), " "), 1, n), " ").alias("text"))


def _draw(key: str, k: int, seed: int) -> list[Column]:
    return [0.1 + V.uniform(seed + i, F.col(key)) for i in range(k)]


def _squared_error(cells: DataFrame, w: DataFrame, h: DataFrame, k: int) -> float:
    """||V - W H||^2 = ||V||^2 - 2 sum of v (w . h) + trace of both Gram matrices, so zeros of V are never stored."""
    whole = cells.agg(F.sum(F.col("v") * F.col("v"))).first()[0]
    met = cells.join(w.withColumnRenamed("x", "y"), "r").join(h, "c")
    cross = met.agg(F.sum(F.col("v") * V.dot(F.col("x"), F.col("y")))).first()[0]
    gram = lambda side: np.array(side.agg(*(F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(k) for j in range(k))).first(), dtype=float)
    return float((whole or 0.0) - 2 * (cross or 0.0) + gram(w) @ gram(h))


def nmf(
    cells: DataFrame, k: int, rounds: int = 60, row: str = "doc", column: str = "term", value: str = "weight", random_state: int = 0, tolerance: float = 1e-3
) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors W (row, w array) and H (column, h array) by multiplicative updates on the stored cells.

    A round is two passes over blocks of cells, which stay where they are (see
    `Blocks`); k x k Gram matrices reach the driver.  Ends after `rounds`, or
    when five rounds lower the error by less than `tolerance` of it.  Negative
    values raise.  Runs at once.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    cells = settle(cells.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v")))
    least, squares = cells.agg(F.min("v"), F.sum(F.col("v") * F.col("v"))).first()
    if (least or 0.0) < 0:
        raise ValueError("values must not be negative")
    blocks, error = Blocks(cells), None
    w, h = blocks.vectors("r", _draw("key", k, random_state)), blocks.vectors("c", _draw("key", k, random_state + 1000))
    for n in range(1, rounds + 1):
        h = blocks.multiply(w, k, "c", mine=h, change=lambda up, x, g=gram(w, k): x * up / (g @ x + 1e-12))
        g = gram(h, k)
        w = blocks.multiply(h, k, "r", mine=w, change=lambda up, x, g=g: x * up / (g @ x + 1e-12))
        if n % 5 == 0:
            # ||V - W H||^2 = ||V||^2 - 2 sum of v (w . h) + trace of both Gram matrices
            now = float((squares or 0.0) - 2 * (w.agg(F.sum("s")).first()[0] or 0.0) + (gram(w, k) * g).sum())
            if error is not None and error - now <= tolerance * error:
                break
            error = now
    blocks.release()
    return blocks.unpacked(w, k, "r").toDF(row, "w"), blocks.unpacked(h, k, "c").toDF(column, "h")


def nmf_transform(cells: DataFrame, h: DataFrame, rounds: int = 30, row: str = "doc", column: str = "term", value: str = "weight", random_state: int = 0) -> DataFrame:
    """(row, w array): the weights of new rows over fixed factors (column, h array); columns that H does not know are left out.

    What pulls a row's weights is one join, since H is fixed; the updates after that are the row's own.
    """
    theirs = settle(h.select(F.col(column).alias("c"), F.col("h").alias("y")))
    k = len(theirs.select("y").first()[0])
    square = np.array(theirs.agg(*(F.sum(F.col("y")[i] * F.col("y")[j]) for i in range(k) for j in range(k))).first(), dtype=float).reshape(k, k)
    met = cells.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v")).join(theirs, "c")
    pull = met.groupBy("r").agg(F.array(*(F.sum(F.col("v") * F.col("y")[i]) for i in range(k))).alias("up"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, up = matrix(b.column(1)), matrix(b.column(2))
                for _ in range(rounds):
                    x = x * up / (x @ square + 1e-12)
                yield pa.RecordBatch.from_arrays([b.column(0), lists(x)], names=[row, "w"])

    drawn = pull.where("r is not null").select("r", F.array(*_draw("r", k, random_state)).alias("x"), "up")
    return drawn.mapInArrow(run, f"`{row}` {drawn.schema['r'].dataType.simpleString()}, w array<double>")


def reconstruction_error(cells: DataFrame, w: DataFrame, h: DataFrame, row: str = "doc", column: str = "term", value: str = "weight") -> float:
    """The Frobenius norm of V - W H over all rows and columns, stored or not."""
    k = len(h.select("h").first()[0])
    named = cells.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(value).cast("double").alias("v"))
    return max(0.0, _squared_error(named, w.select(F.col(row).alias("r"), F.col("w").alias("x")), h.select(F.col(column).alias("c"), F.col("h").alias("x")), k)) ** 0.5
