"""Suffix-array deduplication over sparse suffixes.

Suffixes are retained where a minimiser starts: the run of ``LETTER`` words with the least hash
among ``SPAN`` neighbouring runs. Which positions these are depends on content alone, and every
passage of ``WINDOW = LETTER + SPAN - 1`` words holds one, the same one in all its copies. The
retained suffixes are sorted across the cluster: by their first ``PREFIX`` bytes as they stand, and
where these tie by the hash of their first ``LETTER`` words, which puts equal runs next to each
other. Neighbours in that order are compared; those that agree with a neighbour of another text are
extended left and right, as far as windows of ``WINDOW`` words that hold them are equal (exact
hashes, see ``passages``).

The sort is a range exchange on (prefix, hash, text, position), so a suffix that a third of all
documents share is spread over many tasks. The first and last suffix of a task count as shared:
their neighbours are elsewhere, and what does not extend is dropped in the exact step. Windows are
dealt out as in ``passages``, so a hot one doesn't fill its bucket; the bucket names the least document
of each window that others have, and the first window of each span looks it up.

Result: a row per maximal repeated span, ``doc_id, start_word, n_words, first_doc_id``; the span's
windows all start in a smaller document too, and ``first_doc_id`` is the least such document of
its first window. The first document of a passage is not listed, nor is any document without
repeats. Defined results: null texts and texts under ``WINDOW`` words have no spans; rows with a
null ``doc_id`` take no part; rows that share a ``doc_id`` do not repeat each other; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import checkpointed, drop, parallelism, saved

#: Bytes of a suffix that it is sorted by as they stand.
PREFIX = 24
LETTER = 25
SPAN = 26
WINDOW = LETTER + SPAN - 1
#: Suffixes that a task sorts, about.
TASK_SUFFIXES = 1_000_000


def _slide(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """``of`` over each ``width`` neighbours, by doubling."""
    size = 1
    while size < width:
        step = min(size, width - size)
        x = of(x[: len(x) - step], x[step:])
        size += step
    return x


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Places that hold the least hash of some ``SPAN`` neighbours (all, if tied)."""
    if len(hashes) < SPAN:
        return np.zeros(0, np.int64)
    least = _slide(hashes, SPAN, np.minimum)
    # the windows that hold a place have minima of at most its hash; it is chosen if one is equal
    none = np.zeros(SPAN - 1, np.uint64)
    best = _slide(np.concatenate((none, least, none)), SPAN, np.maximum)
    return np.flatnonzero(best == hashes)


def sorted_neighbours(texts: DataFrame) -> DataFrame:
    """Sorts the retained suffixes of ``texts(text_key, data)`` across the cluster; ``(text_key,
    place)`` of those with a neighbour of another text that starts alike."""
    names = ["prefix", "suffix", "text_key", "place"]

    def retained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for key, x in zip(b.column("text_key").to_pylist(), b.column("data"), strict=True):
                words = x.as_py().split()
                if len(words) < WINDOW:
                    continue
                hashes = passages.rolled(passages.word_hashes(x.as_py())[0], LETTER)
                at = minimisers(hashes)
                found.append(([b" ".join(words[k : k + PREFIX // 2])[:PREFIX] for k in at.tolist()], hashes[at].view(np.int64), np.full(len(at), key, np.int64), at.astype(np.int32)))
            if found:
                prefixes, *others = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([p for x in prefixes for p in x], pa.binary()), *(pa.array(np.concatenate(x)) for x in others)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        h, key, place = (np.concatenate([b.column(n).to_numpy() for b in held]) for n in names[1:])
        if not len(h):
            return
        # equal hashes have equal prefixes: both are of the same words
        same = h[1:] == h[:-1]
        other = same & (key[1:] != key[:-1])
        # within a run of equal suffixes sorted by text, one change of text marks the whole run
        starts = np.flatnonzero(np.r_[True, ~same])
        changed = np.add.reduceat(np.r_[other, False].astype(np.int64), starts) > 0
        changed[0] = changed[-1] = True
        shared = np.repeat(changed, np.diff(np.r_[starts, len(h)]))
        yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(place[shared])], names=["text_key", "place"])

    spark = texts.sparkSession
    # (written first: the range exchange reads its input twice, to find the ranges)
    rows = saved(texts.mapInArrow(retained, "prefix binary, suffix long, text_key long, place int"))
    size = texts.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    tasks = max(parallelism(spark), int(size / passages.WORD_BYTES * 2 / SPAN) // TASK_SUFFIXES)
    out = saved(rows.repartitionByRange(tasks, *names).sortWithinPartitions(*names).mapInArrow(compare, "text_key long, place int"))
    drop(rows)
    return out


def least_marked(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As ``passages.least_document``; the least document's windows are marked where there are
    others."""
    least, others = passages.least_document(columns)
    h, check, _, _, start = columns
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
    start[least & np.repeat(np.logical_or.reduceat(others, first), np.diff(np.r_[first, len(h)]))] += passages.SHARED
    return least, others


_LATER = "doc_id long, text_key long, start int, hash long, check long, first_doc_id long"


def later_and_least(t: pa.Table) -> pa.Table:
    """Of a bucket: the windows that a smaller document has; and, in rows without document, those
    that several have, with the least."""
    parts = []
    known = t.filter(t["known"])
    if known.num_rows:
        parts.append(passages.unpacked(known, *passages.WINDOWS))
    t = t.filter(pc.invert(t["known"]))
    shared = [np.zeros(0, d) for d in ("<u8", "<u4", "<i8")]
    if t.num_rows:
        columns = passages.unpacked(t, *passages.WINDOWS)
        marked = columns[4] < 0
        columns[4] = columns[4] & passages.PLACE
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns, marked = [c[order] for c in columns], marked[order]
        _, later = passages.least_document(columns)
        h, check, doc, *_ = columns
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
        several = first[np.logical_or.reduceat(later | marked, first)]
        shared = [c[several] for c in (h, check, doc)]
        parts.append([c[later] for c in columns])
    h, check, doc, key, start = (np.concatenate(c) for c in zip(*parts, strict=True))
    blank = len(shared[0])
    return pa.table(
        {
            "doc_id": pa.chunked_array([pa.array(doc, pa.int64()), pa.nulls(blank, pa.int64())]),
            "text_key": pa.chunked_array([pa.array(key, pa.int64()), pa.nulls(blank, pa.int64())]),
            "start": pa.chunked_array([pa.array(start, pa.int32()), pa.nulls(blank, pa.int32())]),
            "hash": np.concatenate([h, shared[0]]).view(np.int64),
            "check": np.concatenate([check, shared[1]]).astype(np.int64),
            "first_doc_id": pa.chunked_array([pa.nulls(len(doc), pa.int64()), pa.array(shared[2], pa.int64())]),
        }
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    data = passages.prepared(docs)
    buckets = passages.buckets_for(data, 2.0)
    spots, copies = passages.suspects(data, sorted_neighbours, WINDOW, count=True)

    def dealer() -> passages.Dealer:
        return passages.Dealer(*passages.WINDOWS, buckets, least_marked)

    dealt = passages.suspect_windows(data, spots, LETTER, WINDOW, dealer().schema, dealer)
    found = saved(dealt.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(later_and_least, _LATER))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start_word", "n_words", "hash", "check"]
        for b in batches:
            out = []
            for doc, held in zip(b.column("doc_id").to_pylist(), b.column("found"), strict=True):
                at, h, check = (held.values.field(n).to_numpy().astype(np.int64) for n in ("start", "hash", "check"))
                order = np.argsort(at, kind="stable")
                at, h, check = at[order], h[order], check[order]
                begins = np.flatnonzero(np.r_[True, at[1:] > at[:-1] + WINDOW])
                ends = np.r_[begins[1:], len(at)] - 1
                out.append((np.full(len(begins), doc), at[begins], at[ends] + WINDOW - at[begins], h[begins], check[begins]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names=names)

    first = checkpointed(found.where("doc_id is null").select("hash", "check", "first_doc_id"))
    grouped = found.where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "hash", "check")).alias("found"))
    begun = checkpointed(grouped.select("doc_id", "found").mapInArrow(spans, "doc_id long, start_word long, n_words long, hash long, check long"))
    whole = copies.where(F.col("n_words") >= WINDOW).groupBy("doc_id", "text_key", "n_words").agg(F.min("copy_of").alias("first_doc_id"))
    whole = checkpointed(whole.select("doc_id", F.lit(0).cast("long").alias("start_word"), "n_words", "first_doc_id"))
    drop(spots, copies, found)
    partly = begun.join(first, ["hash", "check"]).select("doc_id", "start_word", "n_words", "first_doc_id")
    return partly.unionByName(whole)
