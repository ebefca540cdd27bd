"""From raw documents to token ids: filter, deduplicate, decontaminate, redact, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver
writes it and hands it to the next.  All but the last return the columns of
`docs`, whatever they are, with `doc_id` and `text` among them.

In every stage null and empty texts count as texts without words, very long
ones are read whole, null ids are ids like any other, and an empty table gives
an empty one.  Only the near-dedup stage drops repeated rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm import bpe, decontaminate, quality, secrets, similar
from patternloom.llm.common import table
from patternloom.llm.queries import VOCABULARY

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_sound(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the rated ones among them, keeps; all of them where none is rated."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of least id, of every group of texts linked by a five-word-shingle similarity of 0.8 or more.

    The groups are found by SimHash fingerprints and completed by exact
    comparison; rows that repeat an id with another text are rows of their own.
    """
    return similar.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, told apart by id and text."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; `n_chars` follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every row; other columns are left out."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_sound),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("byte-level bpe", encode),
]

#: The classifier and the grammar are trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
