"""SimHash near-duplicates with pivot distance tables.

Fingerprints are made per document in Python workers. Equal ones collapse into a row, so copies
never make pairs. Distinct fingerprints meet in groups that agree in three of seven segments of
bits (two fingerprints that differ in at most four bits agree in three at least). Inside a group
pairs are discarded by the pivot table, which has each fingerprint's Hamming distances to fixed
reference fingerprints: by the triangle inequality, if any coordinate differs by more than four,
so do the fingerprints. Survivors are verified on their bits. Groups of more than ``SMALL`` emit a
spanning forest, found breadth first, and not their pairs. Components follow by star contraction.

Why segments as well: distances of 64-bit fingerprints to any reference crowd around 32, so
pivot coordinates alone have no selective equality key to shuffle by, and without one the
operator would compare all with all.

Defined results: null text has no words; texts without words have fingerprint zero and link like
any other; rows without ``doc_id`` are fingerprinted and link others, but name no component
(a component of such rows alone has a null id); repeated rows each give a row; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, first_of_each, parallelism
from .components import connected_components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Bits in each segment; any ``MAX_BITS`` bits leave ``len(SEGMENTS) - MAX_BITS`` untouched.
SEGMENTS = (9, 9, 9, 9, 9, 9, 10)
PIVOTS = 24
#: Groups up to this size are compared pair by pair.
SMALL = 8
#: Group rows that a task takes.
TASK_ROWS = 2_000_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(data: bytes, words: int = SHINGLE_WORDS, seed: int = SEED) -> bytes:
    """Eight bytes, highest bit first, of a text in UTF-8."""
    tokens = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_digest
    if len(tokens) <= words:
        return digest(joined, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: len(tokens) - words].tolist()]
    hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    count = np.zeros(64, np.int64)
    for k in range(0, len(bits), CHUNK):
        count += np.unpackbits(bits[k : k + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * count > len(bits)).tobytes()


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_key, fp long)`` per row of ``docs(doc_id, text)``."""
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b"".join([fingerprint(x.as_py(), words, seed) for x in b.column("data")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), pa.array(np.frombuffer(fps, ">i8").astype(np.int64))], names=["doc_id", "text_key", "fp"])

    return docs.mapInArrow(run, "doc_id long, text_key long, fp long")


@cache
def pivots() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([k]), SEED) for k in range(PIVOTS)], np.uint64)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)


def close(left: np.ndarray, right: np.ndarray, bits: int, tables: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Which pairs of fingerprints are within ``bits``: the pivot tables (made here, if not given)
    discard, the bits confirm."""
    alive = np.arange(len(left))
    a, b = tables or (pivot_table(left), pivot_table(right))
    for k in range(0, PIVOTS, 6):
        apart = np.abs(a[alive, k : k + 6] - b[alive, k : k + 6]).max(axis=1)
        alive = alive[apart <= bits]
        if not len(alive):
            break
    out = np.zeros(len(left), bool)
    out[alive[np.bitwise_count(left[alive] ^ right[alive]) <= bits]] = True
    return out


def _close(fps: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    return close(fps[left], fps[right], bits, (table[left], table[right]))


def _forest(fps: np.ndarray, table: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Breadth first: (index, indexes it reaches first)."""
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = _close(fps, table, np.full(len(rest), at), rest, bits)
            if near.any():
                yield at, rest[near]
                queue += rest[near].tolist()
                rest = rest[~near]


def links(key: np.ndarray, fps: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal ``key`` that join all that is within ``bits`` there."""
    order = np.lexsort((fps, key))
    key, fps = key[order], fps[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    many = np.repeat(sizes, sizes) > 1
    key, fps = key[many], fps[many]
    a, b = [], []
    if not len(key):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    table = pivot_table(fps)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    for step in range(1, SMALL):
        at = np.flatnonzero((np.repeat(sizes, sizes) <= SMALL)[:-step] & (key[step:] == key[:-step])) if len(key) > step else np.zeros(0, int)
        near = _close(fps, table, at, at + step, bits)
        a.append(fps[at[near]])
        b.append(fps[at[near] + step])
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        for at, reached in _forest(fps[s : s + n], table[s : s + n], bits):
            a.append(np.full(len(reached), fps[s + at]))
            b.append(fps[s + reached])
    return np.concatenate(a), np.concatenate(b)


def _keyed(distinct: DataFrame, bits: int, segments: tuple[int, ...]) -> DataFrame:
    """``(key, fp)`` for each choice of segments that must agree."""
    starts = np.cumsum([0, *segments]).tolist()
    parts = [((1 << n) - 1) << s for s, n in zip(starts, segments, strict=False)]
    masks = np.array([sum(chosen) for chosen in combinations(parts, len(parts) - bits)], np.uint64).view(np.int64).tolist()
    chosen = distinct.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    return chosen.select(F.xxhash64("mask", F.col("mask").bitwiseAND(F.col("fp"))).alias("key"), "fp")


def link_tasks(distinct: DataFrame, bits: int = MAX_BITS, segments: tuple[int, ...] = SEGMENTS) -> int:
    return max(parallelism(distinct.sparkSession), -(-distinct.count() * comb(len(segments), bits) // TASK_ROWS))


def near_links(distinct: DataFrame, tasks: int, bits: int = MAX_BITS, segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """Distinct links ``(a, b)`` that connect all fingerprints of ``distinct(fp)`` within ``bits`` of
    each other; these meet by ``len(segments) - bits`` of the ``segments``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        key, fp = (np.concatenate([b.column(c).to_numpy() for b in held] or [np.zeros(0, np.int64)]) for c in ("key", "fp"))
        a, b = links(key, fp.view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return _keyed(distinct, bits, segments).repartition(tasks, "key").mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, fp, component_id)`` per row."""
    fps = checkpointed(fingerprints(docs))
    groups = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(near_links(groups, link_tasks(groups)))
    named = groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # (written before it is joined: Spark splits a plain join's hot root or fingerprint)
    least = checkpointed(named.groupBy("root").agg(F.min("first").alias("component_id")))
    label = checkpointed(named.join(least, "root").select("fp", "component_id"))
    return fps.join(label, "fp").select("doc_id", "text_key", "fp", "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    return first_of_each(docs, near_duplicates(docs))
