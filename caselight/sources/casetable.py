"""Reports clustered for newest-first pages and scans by time.

A folder a month; within it, files hold ranges of time and key that don't overlap, newest first. A keyset page
starts in its cursor's month, reads what lies behind the cursor, and goes on to the month before only when the
page is not full, so it reads the tail of one month at most times, however long the table is.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where reports without a time are.
UNDATED = "0000-00"


def write(rows: DataFrame, path: str, at: str = "created_at", key: str = "case_key", files: int | None = None) -> None:
    """Appends ``rows``; ``files`` ranges in all (the session's shuffle partitions, if not given)."""
    files = files or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dated = rows.withColumn("month", F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(UNDATED)))
    order = (F.desc("month"), F.desc(at), F.desc(key))
    dated.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("append").partitionBy("month").parquet(path)


def months(spark: SparkSession, path: str) -> list[str]:
    """The table's months, the newest first: names of folders."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(folder)
    names = [s.getPath().getName() for s in found if s.isDirectory()]
    return sorted((n.removeprefix("month=") for n in names if n.startswith("month=")), reverse=True)


def scan(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """The reports from one month to another; other folders are not read."""
    return spark.read.option("basePath", path).parquet(path).where(F.col("month").cast("string").between(first, last))


def page(spark: SparkSession, path: str, size: int, after: tuple[date, int] | None = None, at: str = "created_at", key: str = "case_key") -> tuple[DataFrame, list[str]]:
    """The ``size`` reports behind ``after`` (time and key of the last one seen), newest first, and the months
    that were read."""
    parts: list[DataFrame] = []
    found, read = 0, []
    for month in months(spark, path):
        if after is not None and month > after[0].strftime("%Y-%m"):
            continue
        rows = spark.read.parquet(f"{path}/month={month}")
        if after is not None:
            rows = rows.where((F.col(at) < F.lit(after[0])) | ((F.col(at) == F.lit(after[0])) & (F.col(key) < after[1])) | F.col(at).isNull())
        part = rows.orderBy(F.desc(at), F.desc(key)).limit(size - found)
        read.append(month)
        parts.append(part)
        found += part.count()  # ``size`` rows at most
        if found >= size:
            break
    if not parts:
        return spark.read.parquet(path).drop("month").limit(0), read
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, read
