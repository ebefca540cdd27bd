"""A running k-means over a stream of micro-batches, with drift figures, that survives restarts.

What the stream knows after a micro-batch, k centres, their counts and the bins
of the first batch, is one small JSON table of its own under the batch's number,
written to shared storage.  A micro-batch starts from the state before it and
writes its own state and figures in place of any it has left there, so one that
Spark repeats after a failure gives the same result and counts once.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patternloom.operators import cluster
from patternloom.operators.drift import step_centres
from patternloom.operators.order import quantiles

FIGURES = "batch long, n_seen long, centroid_shift double, inertia double, psi double"
BINS, LEAST_SHARE = 10, 1e-6


def psi_of(first: list[int], now: list[int]) -> float:
    """The population stability index of two lists of counts, shares floored at `LEAST_SHARE`."""
    from math import log

    shares = [(max(a / max(sum(now), 1), LEAST_SHARE), max(e / max(sum(first), 1), LEAST_SHARE)) for e, a in zip(first, now, strict=True)]
    return sum((a - e) * log(a / e) for a, e in shares)


def advance(state: dict | None, batch: DataFrame, k: int, column: int, id_col: str = "id", x: str = "x") -> tuple[dict, dict]:
    """The state after a micro-batch, and its figures; a few aggregates over the batch, whose rows stay where they are.

    Without a state the centres are the first k rows by id, and the batch's
    quantiles the edges of the bins that later batches are held against.
    """
    rows = batch.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(x)[column].alias("v"))
    first = state is None
    if first:
        centres = [list(r["x"]) for r in rows.orderBy("id").limit(k).collect()]
        if len(centres) < k:
            raise ValueError("the first batch has fewer rows than clusters")
        edges = sorted({round(q, 9) for q in quantiles(rows, ["v"], [i / BINS for i in range(BINS + 1)]).first()["v"]})
        state = {"centres": centres, "weights": [0.0] * k, "n_seen": 0, "inner": edges[1:-1], "bins": max(len(edges) - 1, 0), "base": None}
    centres, d = state["centres"], len(state["centres"][0])
    near = rows.join(cluster.assign(rows, centres).select("id", "label"), "id")
    at = F.size(F.filter(F.array(*map(F.lit, state["inner"])).cast("array<double>"), lambda e: e <= F.round("v", 9)))
    sums = near.groupBy("label", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d))).collect()
    counts, total, seen = [0] * max(state["bins"], 1), {}, 0
    for r in sums:
        counts[min(r["bin"], len(counts) - 1)] += r["n"]
        n, s = total.get(r["label"], (0, [0.0] * d))
        total[r["label"]] = n + r["n"], [a + r[f"s{i}"] for i, a in enumerate(s)]
        seen += r["n"]
    new, weights = step_centres(centres, state["weights"], total)
    shift = None if first else sum(sum((p - q) ** 2 for p, q in zip(a, c, strict=True)) ** 0.5 for a, c in zip(new, centres, strict=True)) / k
    inertia = cluster.assign(rows, new).agg(F.sum("d2")).first()[0]
    after = state | {"centres": new, "weights": weights, "n_seen": state["n_seen"] + seen, "base": state["base"] or counts}
    psi = None if first else 0.0 if state["bins"] < 1 else psi_of(after["base"], counts)
    return after, {"n_seen": after["n_seen"], "centroid_shift": shift, "inertia": inertia, "psi": psi}


def _path(folder: str, kind: str, batch: int) -> str:
    return f"{folder}/{kind}/batch={batch}"


def _write(spark: SparkSession, folder: str, kind: str, batch: int, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(_path(folder, kind, batch))


def state_of(spark: SparkSession, folder: str, batch: int) -> dict | None:
    """What was known after micro-batch `batch`; None before the first."""
    if batch < 0:
        return None
    return json.loads(spark.read.text(_path(folder, "state", batch), wholetext=True).first()[0])


def keep_clusters(folder: str, k: int, column: int = 0, id_col: str = "id", x: str = "x") -> Callable[[DataFrame, int], None]:
    """What `foreachBatch` takes: micro-batches move the centres kept in `folder`, a path of any store that driver and executors share."""
    if k < 2:
        raise ValueError("k must be at least 2")

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        before = state_of(spark, folder, batch - 1)
        if rows.isEmpty():
            after, figures = before, None
        else:
            after, figures = advance(before, rows, k, column, id_col, x)
        _write(spark, folder, "state", batch, after)
        if figures:
            _write(spark, folder, "figures", batch, {"batch": batch, **figures})

    return run


def cluster_stream(stream: DataFrame, folder: str, k: int, column: int = 0, id_col: str = "id", x: str = "x") -> StreamingQuery:
    """Start the running k-means on all that a stream has; a later start goes on where this one ended."""
    query = stream.writeStream.foreachBatch(keep_clusters(folder, k, column, id_col, x)).option("checkpointLocation", f"{folder}/checkpoint")
    return query.trigger(availableNow=True).start()


def figures(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, n_seen, centroid_shift, inertia, psi) of every micro-batch so far; the first has no shift and no psi."""
    lines = spark.read.text(f"{folder}/figures")
    return lines.select(F.from_json("value", FIGURES).alias("f")).select("f.*")


def assign_stream(rows: DataFrame, folder: str, batch: int, id_col: str = "id", x: str = "x") -> DataFrame:
    """(id, label, d2) of any rows by the centres as they were after micro-batch `batch`."""
    return cluster.assign(rows, state_of(rows.sparkSession, folder, batch)["centres"], id_col, x)
