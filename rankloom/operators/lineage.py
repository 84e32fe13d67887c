"""Cutting lineage so that lost executors cost no recomputation of what came before."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster raises, since a folder of one
    machine would lose data there.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. Set spark.cleaner.referenceTracking.cleanCheckpoints to have it removed."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder of its own in the shared one, for a written table; the caller removes it when done."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
