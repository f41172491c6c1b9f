"""A store of linked reports that is loaded batch by batch.

``reports`` holds the compared values and labels of all reports, ``anchors`` and ``hashes`` the states that linkage
needs; all are partitioned by a bucket of their key. A load labels what the batch touches and overwrites the
buckets that hold it, no others; a bucket is written beside the store first, since it is read while it is
made. A load that is repeated finds its reports in the store and leaves them out.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.operators import anchors

BUCKETS = 64
PARTS = {"reports": "anchor", "anchors": "anchor", "hashes": "source_hash"}


def _bucket(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def read(spark: SparkSession, path: str, part: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{part}")


def create(path: str, cases: DataFrame) -> None:
    """A store of a first batch."""
    rows = anchors.points(cases)
    known, hashes = anchors.states(rows), anchors.hash_states(rows)
    labels = anchors.labelled(rows, known, hashes)
    made = {"reports": rows.join(labels, "case_key"), "anchors": known, "hashes": hashes}
    for part, key in PARTS.items():
        made[part].withColumn("bucket", _bucket(key)).write.partitionBy("bucket").parquet(f"{path}/{part}")


def load(spark: SparkSession, path: str, cases: DataFrame) -> int:
    """Links a batch to the store; returns how many reports were labelled. Keys are unique; reports whose key the
    store has are left out."""
    stored = read(spark, path, "reports")
    new = anchors.points(cases).join(stored.select("case_key"), "case_key", "left_anti")
    known, hashes = read(spark, path, "anchors").drop("bucket"), read(spark, path, "hashes").drop("bucket")
    labels, all_anchors, all_hashes = anchors.relabel(stored.drop("relation", "changed", "bucket"), stored.select("case_key", "relation", "changed"), known, hashes, new)
    rows = stored.drop("relation", "changed", "bucket").unionByName(new).join(labels, "case_key").withColumn("bucket", _bucket("anchor"))
    hit = rows.where("touched").groupBy("bucket").agg(F.count("*").alias("n")).collect()  # BUCKETS rows at most
    if not hit:
        return 0
    changed = {"reports": rows.drop("touched").where(F.col("bucket").isin([r["bucket"] for r in hit]))}
    for part, key, table, fresh in (("anchors", "anchor", all_anchors, new.where("anchor is not null")), ("hashes", "source_hash", all_hashes, new.where("source_hash is not null"))):
        buckets = [r["bucket"] for r in fresh.select(_bucket(key).alias("bucket")).distinct().collect()]  # BUCKETS at most
        changed[part] = table.withColumn("bucket", _bucket(key)).where(F.col("bucket").isin(buckets))
    beside = f"{path}/_beside/{uuid4().hex}"
    for part, df in changed.items():  # all are made before any is replaced: each reads the others
        df.write.parquet(f"{beside}/{part}")
    for part in changed:
        spark.read.parquet(f"{beside}/{part}").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{part}")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(beside)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return sum(r["n"] for r in hit)
