"""Intake as a stream: files or rows are extracted and scored as they come; windowed counts with
late data; sinks that take a batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.operators.extraction import extract


def extracted(stream: DataFrame) -> DataFrame:
    """Stateless; the same plan as in batch."""
    return extract(stream)


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window; rows later than the watermark are dropped and state is freed."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def once(path: str, stamp: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that appends a batch to the Parquet table at ``path`` and, when it meets a batch again
    (a restart after a failure between write and commit), adds what is missing of it, and no row twice.

    Rows are stored with the batch's number and their place among equal rows of it, so that two equal rows of
    one batch both stay. Only the batch's own partition is read. ``stamp`` may add columns of the write."""

    def write(rows: DataFrame, batch: int) -> None:
        from pyspark.sql.window import Window

        spark, names = rows.sparkSession, rows.columns
        key = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
        equal = Window.partitionBy("_key").orderBy(F.lit(0))
        made = rows.withColumn("_key", key).withColumn("_copy", F.row_number().over(equal)).withColumn("_batch", F.lit(batch))
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            there = spark.read.parquet(path).where(F.col("_batch") == batch).select("_key", "_copy")
            made = made.join(there, ["_key", "_copy"], "left_anti")
        stamp(made).write.mode("append").partitionBy("_batch").parquet(path)

    return write
