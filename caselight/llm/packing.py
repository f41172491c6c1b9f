"""Packing token sequences with best-fit decreasing.

A document longer than the window is first cut into full windows; what is left of it, and every
shorter document, is a piece. Pieces are dealt into buckets of about ``BUCKET_PIECES`` by a hash
of ``(doc_id, start, crc)`` and each bucket is packed on its own: longest piece first, each into
the open window with the least room that still holds it, which a segment tree over the remaining
capacities finds. Only lengths are shuffled, never texts or ids, so a bucket is a few MB whatever
the corpus is; one window a bucket is lost to the cut between buckets.

Defined results: null and empty texts are the closing id alone; repeated rows and ids are packed
once each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import checkpointed

WINDOW = 4096
END_ID = 2
BUCKET_PIECES = 65_536


class CapacityTree:
    """Segment tree over capacities 0..size: how many open windows have each; the least capacity
    of at least ``need`` with an open window is found by one climb and one descent."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.width
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, need: int) -> int:
        """The least open capacity >= need, or -1."""
        k, count = need + self.width, self.count
        if count[k]:
            return need
        while k > 1:
            if not k & 1 and count[k + 1]:
                k += 1
                while k < self.width:
                    k *= 2
                    if not count[k]:
                        k += 1
                return k - self.width
            k >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = CapacityTree(window)
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]
    made = 0
    for k, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        room = tree.tightest(need)
        if room < 0:
            room, at = window, made
            made += 1
        else:
            at = open_bins[room].pop()
            tree.add(room, -1)
        bins[k], offsets[k] = at, window - room
        if room > need:
            open_bins[room - need].append(at)
            tree.add(room - need, 1)
    return bins, offsets


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Each document's ids and ``end_id``, cut into full windows and a rest."""
    end = np.array([end_id], "<u4").tobytes()

    def rows(doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> list:
        all_data, at = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
        found = []
        for i, x, y in zip(doc_ids, at, at[1:], strict=False):
            data = all_data[x:y] + end
            n = len(data) // 4
            for a in range(0, n, window):
                part = data[4 * a : 4 * (a + window)]
                found.append((i, a, len(part) // 4, zlib.crc32(part), n, *([part] if keep_ids else [])))
        return list(zip(*found, strict=True))

    return bpe.encode_then(docs, path, rows, PIECE + ", ids binary" * keep_ids)


def pack(parts: DataFrame, window: int = WINDOW, bucket_pieces: int = BUCKET_PIECES) -> DataFrame:
    """``parts`` (of :func:`pieces`) with ``sequence_id`` and ``offset``."""
    parts = checkpointed(parts)
    buckets = max(1, -(-parts.count() // bucket_pieces))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("doc_tokens", "ascending")])
        bins, offsets = best_fit_decreasing(t["length"].to_numpy(), window)
        first = t["bucket"][0].as_py() << 40
        return t.drop_columns(["bucket"]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).alias("bucket")
    return parts.select("*", bucket).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(fit, schema)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The packed sequences themselves, from pieces made with ``keep_ids``: padded to the window,
    but for those whose length is a power of two."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        ids = np.concatenate([np.frombuffer(x, "<u4") for x in t["ids"].to_pylist()]).tolist()
        if len(ids) & (len(ids) - 1):
            ids += [pad_id] * (window - len(ids))
        return pa.table({"sequence_id": [t["sequence_id"][0].as_py()], "ids": pa.array([ids], pa.list_(pa.int32()))})

    return packed.groupBy("sequence_id").applyInArrow(build, "sequence_id long, ids array<int>")


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    return pack(pieces(docs, path, window), window)
