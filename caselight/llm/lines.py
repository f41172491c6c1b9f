"""Line deduplication with two Bloom filters.

Keys of lines, as hashes of 128 bits with their document, are dealt out by hash to as many shards as
``SHARD_KEYS`` go into the corpus. A shard reads its keys into two filters, seen once and seen
again, sized for it; only the suspects, which the second filter holds, are sorted and counted
exactly, and each repeated key's last document is found. Filters never grow with the corpus: more
text makes more shards.

A key that a third of all documents hold doesn't fill its shard. Of what a task gathers (``FLUSH``
keys), a key's largest ``min_documents`` documents go to its shard; if there are more, these lose the
line whatever other tasks have, and go to shards by document, marked as known.

Defined results: null and empty texts are one empty line; rows with a null ``doc_id`` keep all lines
and do not count as documents; rows with one ``doc_id`` are one document; an empty table gives an
empty table; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, checkpointed
from .passages import Dealer, unpacked

MIN_CHARS = 20
MIN_DOCUMENTS = 3
BITS_A_KEY = 16
#: Keys in a shard, about; bytes of text to a key; keys that a shard takes into its filters at once.
SHARD_KEYS = 500_000
LINE_BYTES = 60
AT_ONCE = 1 << 14
_SPACE = SPACE_CHARS.encode()
KEYS = (["hash", "low", "doc_id"], ["<u8", "<u8", "<i8"])


def line_keys(data: bytes) -> list[bytes | None]:
    """For each line of a text in UTF-8 its key's hash, or None if the key is short."""
    out: list[bytes | None] = []
    digest = xxhash.xxh3_128_digest
    for line in data.lower().split(b"\n"):  # bytes: A-Z only
        key = line.strip(_SPACE)
        n = len(key)
        long = n >= 4 * MIN_CHARS or n >= MIN_CHARS and len(key.decode()) >= MIN_CHARS
        out.append(digest(key) if long else None)
    return out


class Filter:
    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.data = np.zeros(bits, bool)

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.data[keys & self.mask].all(axis=1)

    def add(self, keys: np.ndarray) -> None:
        self.data[keys & self.mask] = True


def suspects(keys: np.ndarray) -> np.ndarray:
    """Which of the keys (rows of two hashes) may be there again."""
    bits = 1 << (BITS_A_KEY * len(keys) | 1 << 10).bit_length()
    once, again = Filter(bits), Filter(bits)
    for k in range(0, len(keys), AT_ONCE):
        part, counts = np.unique(keys[k : k + AT_ONCE], axis=0, return_counts=True)
        again.add(part[(counts > 1) | once.has(part)])
        once.add(part)
    return again.has(keys)


def ranked(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys in the order of key and document without repeats: the number of documents above each
    one's own that hold its key, and of all that hold it."""
    new = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])] if len(high) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(high)])
    return np.repeat(starts + sizes, sizes) - 1 - np.arange(len(high)), np.repeat(sizes, sizes)


def _distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Columns in their order, without repeats."""
    if not len(columns[0]):
        return columns
    new = np.any([np.r_[True, c[1:] != c[:-1]] for c in columns], axis=0)
    return [c[new] for c in columns]


def dealer(shards: int, min_documents: int) -> Dealer:
    def pick(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        above, _ = ranked(*columns)
        return above < min_documents, above >= min_documents

    return Dealer(*KEYS, shards, pick, route="doc_id")


def confirmed(t: pa.Table, min_documents: int) -> pa.Table:
    """Of a shard, the keys that each document loses."""
    known = t.filter(t["known"])
    gone = unpacked(known, *KEYS) if known.num_rows else [np.zeros(0, d) for d in KEYS[1]]
    t = t.filter(pc.invert(t["known"]))
    if t.num_rows:
        high, low, doc = unpacked(t, *KEYS)
        again = suspects(np.stack([high, low], axis=1))
        columns = [c[again] for c in (high, low, doc)]
        order = np.lexsort(columns[::-1])
        columns = _distinct([c[order] for c in columns])
        above, holders = ranked(*columns)
        lost = (holders >= min_documents) & (above > 0)
        gone = [np.concatenate([g, c[lost]]) for g, c in zip(gone, columns, strict=True)]
    return pa.table({"drop_id": gone[2], "key": pa.array([x.tobytes() for x in np.stack(gone[:2], axis=1)], pa.binary())})


def dropped_keys(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(drop_id, keys)``: the keys that each document loses."""
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("data")).where("doc_id is not null and data is not null")
    size = data.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    shards = 1 << (int(size / LINE_BYTES) // SHARD_KEYS + 1).bit_length()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = dealer(shards, min_documents)
        for b in batches:
            for doc, x in zip(b.column("doc_id").to_pylist(), b.column("data"), strict=True):
                found = np.frombuffer(b"".join({*line_keys(x.as_py())} - {None}), "<u8").reshape(-1, 2)
                out.add(found[:, 0], found[:, 1], np.full(len(found), doc, np.int64))
                if out.full():
                    yield from out.rows()
        yield from out.rows()

    def confirm(t: pa.Table) -> pa.Table:
        return confirmed(t, min_documents)

    dealt = data.mapInArrow(deal, dealer(shards, min_documents).schema)
    gone = checkpointed(dealt.repartitionById(shards, "bucket").groupBy("bucket").applyInArrow(confirm, "drop_id long, key binary"))
    return gone.groupBy("drop_id").agg(F.collect_list("key").alias("keys"))


def dedup_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines`` and ``n_dropped``."""
    drops = dropped_keys(docs, min_documents)
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    docs = docs.select(F.struct(*rest).alias("rest"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = docs.join(drops, docs["id"] == drops["drop_id"], "left").select("rest", F.col("text").cast("binary").alias("data"), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, gone = [], [], []
            for x, keys in zip(b.column("data"), b.column("keys").to_pylist(), strict=True):
                data = x.as_py()
                n.append(data.count(b"\n") + 1)
                if keys:
                    drop = {*keys}
                    kept = [line for line, key in zip(data.split(b"\n"), line_keys(data), strict=True) if key not in drop]
                    gone.append(n[-1] - len(kept))
                    data = b"\n".join(kept)
                else:
                    gone.append(0)
                texts.append(data)
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["rest", "text", "n_lines", "n_dropped"])

    schema = f"rest {both.schema['rest'].dataType.simpleString()}, text string, n_lines long, n_dropped long"
    return both.mapInArrow(run, schema).select("rest.*", "text", "n_lines", "n_dropped")
