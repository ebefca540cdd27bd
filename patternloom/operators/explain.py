"""What sets clusters apart: profiles, names, exemplars, boundary cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.functions import vectors as V
from patternloom.operators.evaluation import NOISE
from patternloom.operators.prep import numeric, scale


def profile(df: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """(cluster, mean of each column, cluster_size); noise is a cluster like any other."""
    numeric(df, columns)
    return df.groupBy(F.col(label).alias("cluster")).agg(*(F.avg(c).alias(c) for c in columns), F.count(F.lit(1)).alias("cluster_size"))


def _clusters(df: DataFrame, label: str) -> DataFrame:
    """`df` without noise; ValueError unless two clusters are left."""
    kept = df.where(F.col(label) != NOISE) if dict(df.dtypes)[label] != "string" else df
    if kept.select(label).where(F.col(label).isNotNull()).distinct().limit(2).count() < 2:
        raise ValueError("at least two clusters are needed")
    return kept


def distinctive_features(df: DataFrame, columns: Sequence[str], label: str = "label", n_features: int = 3) -> DataFrame:
    """The features whose cluster mean lies furthest from the overall mean, in population deviations of the feature."""
    numeric(df, columns)
    if n_features < 1:
        raise ValueError("n_features must be positive")
    kept = _clusters(df, label)
    facts = kept.agg(*(f for c in columns for f in (F.avg(c).alias(f"{c}__m"), F.stddev_pop(c).alias(f"{c}__s"))))
    means = kept.groupBy(F.col(label).alias("cluster")).agg(*(F.avg(c).alias(c) for c in columns)).crossJoin(F.broadcast(facts))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("cluster_mean"), F.col(f"{c}__m").alias("overall_mean"), F.col(f"{c}__s").alias("sd")) for c in columns)))
    long = means.select("cluster", each.alias("f")).select("cluster", "f.*")
    long = long.withColumn("deviation", (F.col("cluster_mean") - F.col("overall_mean")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))
    order = W.partitionBy("cluster").orderBy(F.desc(F.round(F.abs("deviation"), 9)), "feature")
    top = long.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_features)
    return top.select("cluster", "rank", "feature", "cluster_mean", "overall_mean", "deviation", F.when(F.col("deviation") > 0, "high").otherwise("low").alias("direction"))


def name_clusters(df: DataFrame, columns: Sequence[str], label: str = "label", n_features: int = 2) -> DataFrame:
    """(cluster, name), such as `high x, low y`."""
    top = distinctive_features(df, columns, label, n_features)
    words = F.sort_array(F.collect_list(F.struct("rank", F.concat_ws(" ", "direction", "feature").alias("w"))))
    return top.groupBy("cluster").agg(F.array_join(F.transform(words, lambda s: s["w"]), ", ").alias("name"))


def _with_centres(df: DataFrame, columns: Sequence[str], label: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    kept = _clusters(df, label)
    scaled = scale(kept, columns).select(F.col(id_col).alias("id"), F.col(label).alias("cluster"), F.array(*columns).alias("x"))
    means = scale(kept, columns).groupBy(F.col(label).alias("c")).agg(F.array(*(F.avg(c) for c in columns)).alias("centre"))
    return scaled, means


def exemplars(df: DataFrame, columns: Sequence[str], label: str = "label", id_col: str = "row_id", n_examples: int = 3) -> DataFrame:
    """The rows nearest to their cluster's centre in standardised space, in original units."""
    if n_examples < 1:
        raise ValueError("n_examples must be positive")
    scaled, means = _with_centres(df, columns, label, id_col)
    far = scaled.join(F.broadcast(means), F.col("cluster") == F.col("c")).select("id", "cluster", V.distance(F.col("x"), F.col("centre")).alias("distance_to_centre"))
    top = far.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.round("distance_to_centre", 9), "id"))).where(F.col("rank") <= n_examples)
    return top.join(df.select(F.col(id_col).alias("id"), *columns), "id")


def boundary_cases(df: DataFrame, columns: Sequence[str], label: str = "label", id_col: str = "row_id", n_examples: int = 3) -> DataFrame:
    """The rows of least margin: distance to the nearest other centre less that to their own, in standardised space."""
    if n_examples < 1:
        raise ValueError("n_examples must be positive")
    scaled, means = _with_centres(df, columns, label, id_col)
    all_centres = means.agg(F.sort_array(F.collect_list(F.struct("c", "centre"))).alias("cs"))
    spans = scaled.crossJoin(F.broadcast(all_centres)).select("id", "cluster", F.transform("cs", lambda c: F.struct(F.round(V.distance(F.col("x"), c["centre"]), 9).alias("d"), c["c"].alias("c"))).alias("ds"))
    own = F.filter("ds", lambda d: d["c"] == F.col("cluster"))[0]["d"]
    other = F.array_min(F.filter("ds", lambda d: d["c"] != F.col("cluster")))
    margins = spans.select("id", "cluster", other["c"].alias("nearest_other_cluster"), (other["d"] - own).alias("margin"))
    top = margins.withColumn("rank", F.row_number().over(W.partitionBy("cluster").orderBy(F.round("margin", 8), "id"))).where(F.col("rank") <= n_examples)
    return top.join(df.select(F.col(id_col).alias("id"), *columns), "id")


def surrogate_rules(df: DataFrame, columns: Sequence[str], label: str = "label", max_depth: int = 3) -> tuple[str, DataFrame]:
    """The rules of a shallow tree fitted to the labels, and (fidelity, depth, n_leaves).  Fits at once."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    numeric(df, columns)
    if max_depth < 1:
        raise ValueError("max_depth must be positive")
    ready = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(df).transform(VectorAssembler(inputCols=list(columns), outputCol="_x").transform(df))
    model = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", maxDepth=max_depth, maxBins=256, seed=0).fit(ready)
    rules = model.toDebugString
    for i, c in enumerate(columns):
        rules = rules.replace(f"feature {i} ", f"{c} ")
    found = model.transform(ready).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("fidelity"))
    return rules, found.select("fidelity", F.lit(model.depth).alias("depth"), F.lit((model.numNodes + 1) // 2).alias("n_leaves"))


def persona_cards(df: DataFrame, columns: Sequence[str], label: str = "label", id_col: str = "row_id", n_features: int = 3, n_examples: int = 2) -> str:
    """Markdown, one card per cluster; collects only the few rows of the cards."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect() if r[0] != NOISE}
    names = dict(map(tuple, name_clusters(df, columns, label).collect()))
    features, examples = distinctive_features(df, columns, label, n_features).collect(), exemplars(df, columns, label, id_col, n_examples).collect()
    total, cards = sum(sizes.values()), []
    for cluster in sorted(sizes):
        lines = [f"## Cluster {cluster}: {names[cluster]}", f"- size: {sizes[cluster]} ({sizes[cluster] / total:.1%})"]
        lines += [f"- {f.feature}: {f.direction} ({f.deviation:+.2f} sd)" for f in sorted(features, key=lambda f: f["rank"]) if f.cluster == cluster]
        lines += [f"- example {e.id} at distance {e.distance_to_centre:.3f}" for e in sorted(examples, key=lambda e: e["rank"]) if e.cluster == cluster]
        cards.append("\n".join([*lines, "- action: undecided"]))
    return "\n\n".join(cards)
