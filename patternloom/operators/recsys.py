"""Interactions, factors and recommendations."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patternloom.functions import vectors as V
from patternloom.operators.cells import Blocks, gram
from patternloom.operators.cluster import kmeans
from patternloom.operators.iterate import settle
from patternloom.operators.passes import BLOCK, blocks

#: Scores that a task holds at once.
BATCH = 1 << 23


def cells(df: DataFrame, user: str = "user_id", item: str = "item_id", value: str = "interaction_strength") -> DataFrame:
    """(user_id, item_id, value), duplicates summed; ids must not be negative."""
    if missing := {user, item, value} - set(df.columns):
        raise ValueError(f"columns {sorted(missing)} are missing")
    checked = df.select(*(F.when(F.col(c) >= 0, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} must not be negative")).cast("long")).alias(c) for c in (user, item)), F.col(value).alias("value"))
    return checked.groupBy(F.col(user).alias("user_id"), F.col(item).alias("item_id")).agg(F.sum("value").alias("value"))


def similar_items(factors: DataFrame, item: int, k: int = 5, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, similarity, rank): the k items of greatest cosine to `item`, which is left out; zero vectors have cosine 0."""
    if k < 1:
        raise ValueError("k must be positive")
    one = factors.where(F.col(id_col) == item).select(V.unit(F.col(x)).alias("q"))
    near = factors.where(F.col(id_col) != item).crossJoin(F.broadcast(one)).select(F.col(id_col).alias("id"), V.dot(V.unit(F.col(x)), F.col("q")).alias("similarity"))
    top = near.orderBy(F.desc(F.round("similarity", 9)), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.round("similarity", 9)), "id")))


def recommend(users: DataFrame, items: DataFrame, seen: DataFrame, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(user_id, item_id, score, rank): for each user of (user_id, u) the k unseen items of (item_id, v) with greatest dot product.

    Users and items meet in pairs of blocks, one task each, along with what the
    block of users has seen of the block of items; a task keeps k rows a user.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n_u, n_i = (blocks(side.count(), block) for side in (users, items))
    deal = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = seen.select("user_id", "item_id").distinct().groupBy(deal("user_id", n_u).alias("p"), deal("item_id", n_i).alias("q"), F.col("user_id").alias("id")).agg(F.collect_list("item_id").alias("seen"))
    left = users.select(deal("user_id", n_u).alias("p"), every(n_i).alias("q"), F.col("user_id").cast("long").alias("id"), F.col("u").alias("x")).join(known, ["p", "q", "id"], "left")
    right = items.select(every(n_u).alias("p"), deal("item_id", n_i).alias("q"), F.col("item_id").cast("long").alias("id"), F.col("v").alias("x"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"user_id": [], "item_id": [], "score": []})
        b = b.sort_values("id")
        names, side, out = b["id"].to_numpy(), np.stack(b["x"]).astype(float).T, []
        size = max(1, BATCH // len(names))
        for start in range(0, len(a), size):
            some = a.iloc[start : start + size]
            score = np.stack(some["x"]).astype(float) @ side
            for row, gone in enumerate(some["seen"]):
                if gone is not None and not isinstance(gone, float):
                    gone = np.asarray(gone)
                    at = np.minimum(np.searchsorted(names, gone), len(names) - 1)
                    score[row, at[names[at] == gone]] = -np.inf
            # all that tie with the k-th once rounded stay for the last ranking
            least = np.partition(score, -min(k, len(names)), axis=1)[:, -min(k, len(names))]
            rows, best = np.nonzero((score >= least[:, None] - 2e-9) & np.isfinite(score))
            found = score[rows, best]
            rounded = np.round(found, 9)
            order = np.lexsort((best, -rounded, rows))
            rows, best, found = rows[order], best[order], found[order]
            kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out.append(pd.DataFrame({"user_id": some["id"].to_numpy()[rows[kept]], "item_id": names[best[kept]], "score": found[kept]}))
        return pd.concat(out)

    fresh = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInPandas(meet, "user_id long, item_id long, score double")
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(F.round("score", 9)), "item_id"))
    return fresh.withColumn("rank", rank).where(F.col("rank") <= k)


def item_groups(factors: DataFrame, k: int, fit: Callable[[DataFrame, int], DataFrame] | None = None, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, label): items in `k` groups by the direction of their factors, whatever their length."""
    n = factors.count()
    if not 2 <= k <= n:
        raise ValueError("k must lie between 2 and the number of items")
    return (fit or kmeans)(factors.select(F.col(id_col).alias("id"), V.unit(F.col(x)).alias("x")), k)


def explained_variance(users: DataFrame, cells: DataFrame) -> list[float]:
    """The share of the variance of all cells (user_id, item_id, value) that each direction of user factors (id, x) has.

    Users are those with a cell; what they have no cell for counts as zero.
    """
    k = len(users.select("x").first()[0])
    own = users.agg(*(F.var_pop(F.col("x")[i]) for i in range(k))).first()
    n = F.lit(users.count())
    per = cells.groupBy("item_id").agg((F.sum(F.col("value") * F.col("value")) / n - F.pow(F.sum("value") / n, 2)).alias("v"))
    whole = per.agg(F.sum("v")).first()[0]
    return [v / whole for v in own]


def svd_factors(cells: DataFrame, k: int, rounds: int = 8, random_state: int = 0) -> tuple[DataFrame, DataFrame, list[float]]:
    """Truncated SVD of (user_id, item_id, value) by subspace iteration: user factors U S, item factors V, singular values.

    Each half round is a pass over blocks of cells, which stay where they are
    (see `Blocks`); k x k Gram matrices reach the driver.  Signs: the entry of
    greatest magnitude of an item direction is positive.  Runs at once.
    """
    packed = Blocks(settle(cells.select(F.col("user_id").alias("r"), F.col("item_id").alias("c"), F.col("value").cast("double").alias("v"))))
    items = packed.vectors("c", [V.uniform(random_state + i, F.col("key")) - 0.5 for i in range(k)])

    def upright(side: DataFrame) -> np.ndarray:
        return np.linalg.inv(np.linalg.cholesky(gram(side, k) + 1e-12 * np.eye(k)).T)

    def turn(side: DataFrame, m: np.ndarray) -> DataFrame:
        return side.select("id", F.array(*(sum((F.col("x")[i] * float(m[i, c]) for i in range(k)), F.lit(0.0)) for c in range(k))).alias("x"))

    for _ in range(rounds):
        users = packed.multiply(items, k, "r", turn=upright(items))
        items = packed.multiply(users, k, "c")
    last = upright(items)
    users = packed.multiply(items, k, "r", turn=last)
    packed.release()
    values, rotation = np.linalg.eigh(gram(users, k))
    order = np.argsort(-values)
    rotation = rotation[:, order]
    found = settle(packed.unpacked(items, k, "c", last @ rotation).toDF("id", "x"))
    peaks = found.agg(*(F.max_by(F.col("x")[i], F.struct(F.abs(F.col("x")[i]), -F.col("id"))) for i in range(k))).first()
    sign = np.diag([1.0 if p >= 0 else -1.0 for p in peaks])
    return packed.unpacked(users, k, "r", rotation @ sign).toDF("id", "x"), turn(found, sign), [float(max(v, 0.0)) ** 0.5 for v in values[order]]
