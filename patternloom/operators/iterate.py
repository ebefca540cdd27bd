"""Cutting the lineage of iterations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that driver and executors share: the session's `spark.checkpoint.dir`.

    Only where that is unset and the master is local, as in tests, a local
    folder is made; a cluster without a shared folder raises RuntimeError.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "checkpoints", str(os.getpid())))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """`df` as a table written to the shared folder and read again.

    A plan over a checkpoint goes on with the sizes that the optimiser guessed
    for what is below it, and every join of a loop multiplies them, until
    planning takes longer than the work; a table has the size it has.
    """
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder, which Spark may clear when nothing refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
