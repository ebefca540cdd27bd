"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.operators.iterate import checkpointed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be of any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder that the session names."""
    return checkpointed(df)


def set_aside(df: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`df` with all columns but `keep` under names that clash with no other, and the way back to the columns of `df`."""
    safe = {c: f"__{i}" for i, c in enumerate(df.columns) if c not in keep}
    names = df.columns
    return df.withColumnsRenamed(safe), lambda out: out.select(*(F.col(safe.get(c, c)).alias(c) for c in names))


def partitions(spark: SparkSession) -> int:
    """How many shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(n_bytes: int, piece: int) -> int:
    """How many pieces of about `piece` bytes hold `n_bytes`."""
    return max(1, math.ceil(n_bytes / piece))


def require(df: DataFrame, *columns: str) -> None:
    """Raise ValueError at once when an input column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns {missing} are missing from {df.columns}")
