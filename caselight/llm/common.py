"""What the operators of this subpackage share.

Row identity. Operators that must come back to a document join on ``(doc_id, text_key)``,
null-safe, where ``text_key`` is a 64-bit hash of the text: rows that repeat a ``doc_id`` with
another text keep results of their own, and rows that repeat both get equal results.

Steps. What is read more than once is written to the shared folder, so that lost executors cost
no lineage: ``saved`` for what an operator reads itself (a compressed table, of which only the
needed columns are read again, to be dropped when its readers have run; the shuffle files of its
making are deleted with it), ``checkpointed`` for what the returned DataFrame reads later (Spark
deletes such files, where the session lets it, when nothing refers to them).
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts: space and U+0009 to U+000D.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch, unless the session has a bound of its own: Python workers hold a batch
#: of whole texts or two at a time.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``;
    only where that is unset and all is one process, a temporary folder."""
    context = spark.sparkContext
    bounded_batches(spark)
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="caselight-checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, for as long as something refers to it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, until ``drop``."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid4().hex}"
    with _set(spark, _FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``saved`` made and that nothing will read again."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.saved_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the rows that a smaller ``doc_id`` of their component stands for, where
    ``found`` has ``(doc_id, text_key, component_id)`` of every row. A row goes by its own text's
    component, not by another's that shares its ``doc_id``; rows without ``doc_id`` stay."""
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["gone_key"]), "left_anti")


def parallelism(spark: SparkSession, least: int = 1) -> int:
    """Tasks for a shuffle whose rows are few and large: what the session shuffles into."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
