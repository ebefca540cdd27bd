"""The running k-means as a stream against the fold over batches, with restarts and repeated micro-batches."""

import pytest
from pyspark.sql import functions as F

from patternloom.operators import drift
from patternloom.streaming import clusters


def test_stream_equals_the_fold_and_survives_restarts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select(F.col("event_id").alias("id"), F.array(F.col("value"), F.col("user_id").cast("double")).alias("x"))
    n = rows.count()
    parts = drift.batches(rows, -(-n // 4), "id").cache()
    want = {r.batch: r for r in drift.monitor(parts, 3).collect()}
    schema = rows.schema

    def put(b):
        parts.where(F.col("batch") == b).select("id", "x").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    folder = f"{tmp_path}/kept"
    for b in (0, 1):
        put(b)
    assert clusters.cluster_stream(stream(), folder, 3).awaitTermination(120)
    halfway = clusters.state_of(spark, folder, 1)
    for b in (2, 3):
        put(b)
    assert clusters.cluster_stream(stream(), folder, 3).awaitTermination(120)  # goes on from the checkpoint
    got = {r.batch: r for r in clusters.figures(spark, folder).collect()}
    assert set(got) == set(want) == {0, 1, 2, 3} and got[0].psi is None and got[0].centroid_shift is None
    for b, r in want.items():
        assert got[b].n_seen == r.n_seen and abs(got[b].inertia - r.inertia) < 1e-6 * r.inertia
        assert b == 0 or (abs(got[b].centroid_shift - r.centroid_shift) < 1e-9 and abs(got[b].psi - r.psi) < 1e-9)
    # a micro-batch that is run again starts from what was before it, and leaves what it left
    after = clusters.state_of(spark, folder, 2)
    clusters.keep_clusters(folder, 3)(parts.where("batch = 2").select("id", "x"), 2)
    assert clusters.state_of(spark, folder, 2) == after and clusters.state_of(spark, folder, 1) == halfway and clusters.figures(spark, folder).count() == 4
    labels = clusters.assign_stream(rows, folder, 3)
    assert labels.count() == n and {r.label for r in labels.select("label").distinct().collect()} <= {0, 1, 2}
    with pytest.raises(ValueError):
        clusters.keep_clusters(folder, 1)
    with pytest.raises(ValueError):
        clusters.advance(None, rows.limit(2), 3, 0)
