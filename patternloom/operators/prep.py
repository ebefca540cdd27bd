"""Scaling of feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.operators.order import quantiles


def numeric(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise unless every column is there and holds numbers."""
    if not columns:
        raise ValueError("no feature columns")
    kinds = dict(df.dtypes)
    if missing := [c for c in columns if c not in kinds]:
        raise ValueError(f"columns {missing} are missing")
    if other := [c for c in columns if not kinds[c].startswith(("double", "float", "int", "bigint", "smallint", "tinyint", "decimal"))]:
        raise TypeError(f"columns {other} hold no numbers")


def scaling(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """One row: for each column `c` what to take off (`c__m`) and what to divide by (`c__s`); no spread divides by 1."""
    numeric(df, columns)
    if method == "none":
        facts = [f for _ in columns for f in (F.lit(0.0), F.lit(1.0))]
        one = df.sparkSession.range(1).select(*facts).toDF(*(f"{c}__{p}" for c in columns for p in "ms"))
    elif method == "standard":
        one = df.agg(*(f for c in columns for f in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))))
    elif method == "robust":
        q = quantiles(df, columns, [0.25, 0.5, 0.75])
        one = q.select(*(f for c in columns for f in (F.col(c)[1].alias(f"{c}__m"), (F.col(c)[2] - F.col(c)[0]).alias(f"{c}__s"))))
    else:
        raise ValueError("method must be none, standard or robust")
    return one.select(*(f for c in columns for f in (f"{c}__m", F.when(F.col(f"{c}__s") > 0, F.col(f"{c}__s")).otherwise(1.0).alias(f"{c}__s"))))


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    """`df` with `columns` centred and scaled: by mean and population deviation, or by median and quartile range; no spread scales by 1."""
    one = scaling(df, columns, method)
    if method == "none":
        return df
    scaled = [((F.col(c) - F.col(f"{c}__m")) / F.col(f"{c}__s")).alias(c) if c in columns else F.col(c) for c in df.columns]
    return df.crossJoin(F.broadcast(one)).select(*scaled)
