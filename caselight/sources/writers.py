"""Sinks: append-only reports and audit events, upserts, report files, synthetic cases."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions.text import token_for


def append_reports(reports: DataFrame, path: str) -> None:
    """Reports are immutable; a month's are one folder, so scans by time prune."""
    reports.withColumn("month", F.date_format("created_at", "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def append_audit(events: DataFrame, path: str) -> bool:
    """False, and a logged warning, where the log can't be written: an audit must not stop intake."""
    try:
        events.write.mode("append").parquet(path)
    except (PySparkException, Py4JJavaError, OSError):
        logging.getLogger(__name__).warning("audit events were not written to %s", path, exc_info=True)
        return False
    return True


def write_metrics(metrics: DataFrame, path: str, form: str = "json") -> None:
    """Small tables of metrics as one JSON or CSV file."""
    writer = metrics.coalesce(1).write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def synthetic_cases(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Cases from hashes of their numbers, so any partitioning makes the same ones: a share of 9 %
    repeats an earlier case and 12 % follows one up with another outcome."""
    pick = lambda salt, of: F.element_at(F.array(*[F.lit(x) for x in of]), (F.pmod(F.xxhash64("base", F.lit(salt), F.lit(seed)), F.lit(len(of))) + 1).cast("int"))
    draw = F.pmod(F.xxhash64("id", F.lit("kind"), F.lit(seed)), F.lit(100))
    rows = spark.range(n).withColumn("kind", F.when((F.col("id") == 0) | (draw >= 21), "base").when(draw < 9, "duplicate").otherwise("followup"))
    rows = rows.withColumn("base", F.when(F.col("kind") == "base", F.col("id")).otherwise(F.pmod(F.xxhash64("id", F.lit(seed)), F.col("id"))))
    rows = rows.select("id", "kind", "base", pick("drug", ["Warfarin", "Metformin", "Phenytoin", "Aspirin"]).alias("medicine"), pick("pt", ["rash", "nausea", "seizure", "jaundice"]).alias("reaction"), pick("out", ["Recovered", "Recovering", "Fatal", "Unknown"]).alias("first_outcome"))
    return rows.select("id", "kind", token_for("patient", F.col("base").cast("string")).alias("patient_token"), "medicine", "reaction", F.when(F.col("kind") == "followup", "Recovered with sequelae").otherwise(F.col("first_outcome")).alias("outcome"))
