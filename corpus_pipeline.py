"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``; ``n_chars`` follows the text.
Rules and filters of a stage see only what its predecessors kept.

Defined results: rows with a null ``doc_id`` count as no document where documents are counted or
chosen, so they keep their lines and are never left out as copies; null and empty texts fail the
quality rules; rows that repeat a ``doc_id`` go by their own texts; repeated rows stay or go together;
columns other than those of ``documents`` are dropped by the first stage, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import jaccard, lines, packing, pii, quality
from caselight.llm.common import drop, saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).where("kept").select(*[f"rest.{c}" for c in COLUMNS])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least three hold, but for the last of these."""
    return _measured(lines.dedup_lines(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates: five-word shingles, similarity 0.8."""
    return jaccard.keep_first(docs).select(*COLUMNS)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _measured(pii.masked(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as ``op4_packing`` returns them."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("pii_masking", pii_masking),
    ("packing", pack),
]

#: The first stage's rules are learned and the last packs; SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    written: list[DataFrame] = []
    for _, stage in STAGES[:-1]:
        written.append(saved(stage(spark, docs, sf_dir)))
        docs = written[-1]
        drop(*written[-2:-1])  # its only reader has run
    out = STAGES[-1][1](spark, docs, sf_dir)  # its pieces are written when it returns
    drop(docs)
    return out
