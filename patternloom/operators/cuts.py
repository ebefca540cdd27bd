"""Alert cut-offs without labels, and their evaluation with them.  A row is flagged where score >= threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.operators.order import quantiles, ranked

#: Makes the median absolute deviation of a normal sample its standard deviation.
MAD_SCALE = 1.4826


def checked(df: DataFrame, score: str = "score") -> DataFrame:
    """`df`, once it is known to have two scores at least, all finite; else ValueError."""
    value = F.col(score).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    n, good = df.agg(F.count(F.lit(1)), F.count(F.when(finite, True))).first()
    if n < 2:
        raise ValueError("at least two scores are needed")
    if good < n:
        raise ValueError(f"{n - good} scores are null or not finite")
    return df


def quantile_threshold(df: DataFrame, contamination: float = 0.05, score: str = "score") -> DataFrame:
    if not 0 < contamination < 1:
        raise ValueError("contamination must lie between 0 and 1")
    return quantiles(checked(df, score), [score], [1 - contamination]).select(F.col(score)[0].alias("threshold"))


def mad_threshold(df: DataFrame, n_deviations: float = 3.0, score: str = "score") -> DataFrame:
    """Median plus `n_deviations` scaled median absolute deviations; with none, plus population deviations."""
    if n_deviations <= 0:
        raise ValueError("n_deviations must be positive")
    df = checked(df, score)
    middle = quantiles(df, [score], [0.5]).select(F.col(score)[0].alias("m"))
    away = df.select(score).crossJoin(F.broadcast(middle)).select(F.abs(F.col(score) - F.col("m")).alias("mad"))
    mad = quantiles(away, ["mad"], [0.5]).select(F.col("mad")[0].alias("mad"))
    spread = F.when(F.col("mad") > 0, MAD_SCALE * F.col("mad")).otherwise(F.col("sd"))
    return df.agg(F.stddev_pop(score).alias("sd")).crossJoin(middle).crossJoin(mad).select((F.col("m") + n_deviations * spread).alias("threshold"))


def knee_threshold(df: DataFrame, score: str = "score", id_col: str = "id") -> DataFrame:
    """The score furthest below the straight line from the least to the greatest in sorted order, the first on ties."""
    df = checked(df, score)
    facts = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("n"))
    gap = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("rn") / (F.col("n") - 1) - F.col(score)
    return ranked(df, score, id_col).crossJoin(F.broadcast(facts)).agg(F.max_by(F.col(score), F.struct(F.round(gap, 9), -F.col("rn"))).alias("threshold"))


def otsu_threshold(df: DataFrame, n_bins: int = 128, score: str = "score") -> DataFrame:
    """The right edge of the bin at which the variance between the two sides is greatest, the lowest on ties."""
    if n_bins < 2:
        raise ValueError("n_bins must be at least 2")
    df = checked(df, score)
    facts = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.count(score).alias("n"))
    width = (F.col("hi") - F.col("lo")) / n_bins
    spot = F.least(F.floor((F.col(score) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(n_bins - 1))
    counts = df.crossJoin(F.broadcast(facts)).groupBy(spot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    bins = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").crossJoin(F.broadcast(facts))
    share = F.coalesce("c", F.lit(0)) / F.col("n")
    upto = W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)  # over n_bins rows
    sums = bins.withColumn("p", share).withColumn("m", F.col("p") * (F.col("lo") + (F.col("bin") + 0.5) * width))
    sums = sums.withColumn("sp", F.sum("p").over(upto)).withColumn("sm", F.sum("m").over(upto)).withColumn("st", F.sum("m").over(W.partitionBy(F.lit(1))))
    inside = (F.col("sp") > 1e-12) & (F.col("sp") < 1 - 1e-12)
    between = F.when(inside, F.pow(F.col("st") * F.col("sp") - F.col("sm"), 2) / (F.col("sp") * (1 - F.col("sp"))))
    best = sums.withColumn("between", F.round(between, 9)).where("between is not null")
    return best.agg(F.max_by(F.col("lo") + (F.col("bin") + 1) * width, F.struct("between", -F.col("bin"))).alias("threshold"))


def compare_thresholds(df: DataFrame, contamination: float = 0.05, n_deviations: float = 3.0, score: str = "score", id_col: str = "id") -> DataFrame:
    """(strategy, threshold, n_flagged, flagged_fraction) of the four rules, in one pass over the scores once the thresholds are known."""
    rules = {
        "quantile": quantile_threshold(df, contamination, score),
        "mad": mad_threshold(df, n_deviations, score),
        "knee": knee_threshold(df, score, id_col),
        "otsu": otsu_threshold(df, score=score),
    }
    cut = reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("strategy"), "threshold") for name, t in rules.items()])
    hits = df.select(score).crossJoin(F.broadcast(cut)).groupBy("strategy", "threshold").agg(F.sum((F.col(score) >= F.col("threshold")).cast("long")).alias("n_flagged"), F.count(F.lit(1)).alias("n"))
    return hits.select("strategy", "threshold", "n_flagged", (F.col("n_flagged") / F.col("n")).alias("flagged_fraction"))


def choice(df: DataFrame, threshold: DataFrame, strategy: str, score: str = "score") -> DataFrame:
    """(strategy, threshold, n_flagged, flagged_fraction) of one row (threshold): what a rule would flag."""
    hits = df.select(score).crossJoin(F.broadcast(threshold)).groupBy("threshold").agg(F.count_if(F.col(score) >= F.col("threshold")).alias("n_flagged"), F.count(F.lit(1)).alias("n"))
    return hits.select(F.lit(strategy).alias("strategy"), "threshold", "n_flagged", (F.col("n_flagged") / F.col("n")).alias("flagged_fraction"))


def evaluate_threshold(df: DataFrame, threshold: float, score: str = "score", truth: str = "is_anomaly") -> DataFrame:
    """precision (null if none flagged), recall (null if none true), f1 (null if either is, 0 if both are 0), n_flagged."""
    flag, true = (F.col(score) >= threshold).cast("long"), F.col(truth).cast("long")
    sums = df.agg(F.sum(flag * true).alias("tp"), F.sum(flag).alias("n_flagged"), F.sum(true).alias("pos"))
    p, r = F.try_divide("tp", "n_flagged"), F.try_divide("tp", "pos")
    rates = sums.select(p.alias("precision"), r.alias("recall"), "n_flagged")
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).when(F.col("precision") + F.col("recall") == 0, 0.0)
    return rates.select("precision", "recall", f1.alias("f1"), "n_flagged")
