"""Session settings the engine is written for."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: UTC times, adaptive plans that split skewed joins, Arrow for the few Python steps.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.config(map={**SETTINGS, **more})
    return (builder.master(master) if master else builder).getOrCreate()


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a scan, dealt out to all tasks if it has fewer splits than there are tasks: for work on texts
    that costs far more than their bytes tell. A scan of enough splits passes as it is, without a shuffle."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks) if rows.rdd.getNumPartitions() < tasks else rows


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, the session's ``spark.checkpoint.dir`` (only where that is
    unset and all is one process, a temporary one)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="caselight-checkpoint-"))
    return context.getCheckpointDir()


def once(rows: DataFrame) -> DataFrame:
    """``rows`` as a checkpoint in the shared folder: for what is read more than once."""
    shared_folder(rows.sparkSession)
    return rows.checkpoint(eager=True)


@contextmanager
def held(rows: DataFrame) -> Iterator[DataFrame]:
    """``rows`` as a compressed table in the shared folder, dropped at the block's end: for many and wide rows that are
    read more than once. What is made of them is to be written (:func:`once`) inside."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/held-{uuid4().hex}"
    try:
        rows.write.parquet(path)
        yield spark.read.schema(rows.schema).parquet(path)
    finally:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
