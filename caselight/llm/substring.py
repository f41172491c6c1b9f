"""Substring deduplication with difference-cover anchors.

Anchors are windows of ``ANCHOR`` words at positions whose remainder by ``PERIOD`` is in a
difference cover: for any two positions some shift below ``PERIOD`` puts both on the cover, so
two equal windows of ``ANCHOR + PERIOD - 1`` words hold an equal aligned anchor. From shared
anchors the match extends to whole windows, which are compared exactly (see ``passages``).

Defined results: null and empty texts have no words; rows with a null ``doc_id`` are returned
whole; rows that share a ``doc_id`` remove nothing from each other; repeated rows each give a row;
an empty table gives an empty table; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import checkpointed, drop, saved

WINDOW = 13
PERIOD = 7
#: A difference cover modulo ``PERIOD``: differences of its members take every remainder.
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


def aligned(hashes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.resize(_ON_COVER, len(hashes)))


def removed_windows(docs: DataFrame) -> DataFrame:
    """``(gone_id, gone_key, starts, copy)`` per row that loses words."""
    buckets = passages.buckets_for(docs, PERIOD / len(COVER))
    spots, copies = passages.suspects(docs, passages.dealt_anchors(buckets, aligned, ANCHOR, WINDOW), WINDOW)

    def dealer() -> passages.Dealer:
        return passages.Dealer(*passages.WINDOWS, buckets, passages.least_document)

    dealt = passages.suspect_windows(docs, spots, ANCHOR, WINDOW, dealer().schema, dealer)
    later = saved(dealt.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(passages.later_windows, "doc_id long, text_key long, start int"))
    found = later.select("*", F.lit(False).alias("copy")).unionByName(copies.select("doc_id", "text_key", F.lit(None).cast("int").alias("start"), F.lit(True).alias("copy")))
    gone = checkpointed(found.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).agg(F.collect_list("start").alias("starts"), F.max("copy").alias("copy")))
    drop(spots, copies, later)
    return gone


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words, joined by a space, as ``text``, and ``n_words`` and
    ``n_removed``."""
    gone = removed_windows(passages.prepared(docs))
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.struct(*rest).alias("rest"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("data"))
    both = docs.join(gone, (docs["id"] == gone["gone_id"]) & (docs["key"] == gone["gone_key"]), "left").select("rest", "data", "starts", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, lost = [], [], []
            for x, starts, copy in zip(b.column("data"), b.column("starts"), b.column("copy").to_pylist(), strict=True):
                words = x.as_py().split()
                n.append(len(words))
                if copy:
                    words = words if len(words) < WINDOW else []
                elif starts.is_valid and len(starts.values):
                    words = [words[k] for k in np.flatnonzero(~passages.covered(len(words), starts.values.to_numpy(), WINDOW)).tolist()]
                lost.append(n[-1] - len(words))
                texts.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=["rest", "text", "n_words", "n_removed"])

    schema = f"rest {both.schema['rest'].dataType.simpleString()}, text string, n_words long, n_removed long"
    return both.mapInArrow(run, schema).select("rest.*", "text", "n_words", "n_removed")
