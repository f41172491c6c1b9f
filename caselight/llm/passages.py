"""Exact repeated passages, found from sparse anchors.

Shared by the two operators that remove passages. A passage repeats if a window of ``window``
words of a document also starts in a document with a smaller ``doc_id``. Each operator chooses
anchors so that two equal windows hold an equal anchor at the same place in both; then

1. anchors, as ``(hash, text, position)``, are dealt by hash, and those that two different texts
   share are suspects;
2. only windows that hold a suspect are hashed (96 bits), dealt by hash and matched exactly with
   the least document that has them;
3. texts that are equal as a whole are not compared: all but the first document of a text are
   removed as a whole (if they hold a window at all), and only the first takes part above.

What is dealt out are columns of numbers packed per bucket of hashes, so Spark moves a few large
rows. There are as many buckets as ``BUCKET_ANCHORS`` go into the corpus, so a bucket is a few MB
whatever the corpus is, and a task takes one. A hash that many texts have doesn't fill its bucket: where a task meets it
in two texts or more among ``FLUSH`` numbers, one stands for them in the hash's bucket, for others
to be held against, and what is known to be shared goes to buckets by text.

Positions refer to a text, so rows are identified by ``(doc_id, text_key)``. Null ``doc_id``: the
row neither removes nor loses anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, saved

#: Multiplier of the rolling hash and of its last mixing.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
LOW = np.uint64(0xFFFFFFFF)
#: Numbers gathered before they are dealt out.
FLUSH = 400_000
#: Bytes of the rows that go to Spark at once.
SENT_BYTES = 2_000_000
#: Anchors in a bucket, about, and bytes of text to a word.
BUCKET_ANCHORS = 500_000
WORD_BYTES = 6


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of a text in UTF-8."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join(map(digest, data.split())), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= BASE
        out += words[k : k + n]
    out ^= out >> np.uint64(33)
    out *= MIX
    return out ^ (out >> np.uint64(29))


def buckets_for(docs: DataFrame, words_an_anchor: float) -> int:
    """A power of two, by the bytes of :func:`prepared` texts."""
    size = docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    return 1 << (int(size / WORD_BYTES / words_an_anchor) // BUCKET_ANCHORS + 1).bit_length()


class Dealer:
    """Gathers columns of numbers, the hash first, and packs them by bucket.

    ``pick(columns)`` says, of sorted columns, which rows go to the hash's bucket (the top bits of
    the hash) and which to that of their ``route``, marked as known to be shared. Rows that are
    equal in all columns are sent once.
    """

    def __init__(self, names: list[str], dtypes: list[str], buckets: int, pick: Callable[[list[np.ndarray]], tuple[np.ndarray, np.ndarray]], route: str = "text_key"):
        self.route = route
        self.names, self.dtypes, self.buckets, self.pick = names, dtypes, buckets, pick
        self.shift = np.uint64(64 - (buckets.bit_length() - 1))
        self.held: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    def full(self) -> bool:
        return self.size >= FLUSH

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        columns = [np.concatenate([h[k] for h in self.held]).astype(t) for k, t in enumerate(self.dtypes)]
        self.held, self.size = [], 0
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new = np.any([np.r_[True, c[1:] != c[:-1]] for c in columns], axis=0)
        columns = [c[new] for c in columns]
        sent, known = self.pick(columns)
        key = columns[self.names.index(self.route)].view(np.uint64)
        for rows, hashes, mark in ((sent, columns[0], False), (known, key * MIX, True)):
            at = np.flatnonzero(rows)
            bucket = (hashes[at] >> self.shift).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(at) else at
            ends = [*starts[1:].tolist(), len(at)][: len(starts)]
            picked = [c[at] for c in columns]
            step = max(1, SENT_BYTES * len(starts) // max(1, sum(c.nbytes for c in picked)))
            for k in range(0, len(starts), step):
                cuts = list(zip(starts[k : k + step].tolist(), ends[k : k + step], strict=True))
                packed = [pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()) for c in picked]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts[k : k + step]], pa.int32()), pa.array([mark] * len(cuts), pa.bool_()), *packed], names=["bucket", "known", *self.names])

    @property
    def schema(self) -> str:
        return "bucket int, known boolean, " + ", ".join(f"{n} binary" for n in self.names)


def unpacked(t: pa.Table, names: list[str], dtypes: list[str]) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_py(), d) for x in t[n]]) for n, d in zip(names, dtypes, strict=True)]


#: Marks the place of what is known to be in other texts too; what is left of it without the mark.
SHARED, PLACE = np.int32(-(1 << 31)), np.int32((1 << 31) - 1)
ANCHORS = (["hash", "text_key", "place"], ["<u8", "<i8", "<i4"])


def one_text(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of anchors sorted by hash and text: all of a hash that one text has here, the first of
    others, marked as shared whoever else has it; and all of these others."""
    h, key, place = columns
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[first, len(h)])
    known = np.repeat(key[first] != key[first + sizes - 1], sizes)
    sent = ~known
    sent[first] = True
    place[sent & known] += SHARED
    return sent, known


def shared_anchors(t: pa.Table) -> pa.Table:
    """Of a bucket, the anchors that are known to be shared, and those whose hash two texts have."""
    known = t.filter(t["known"])
    keys, places = [], []
    if known.num_rows:
        _, key, place = unpacked(known, *ANCHORS)
        keys, places = [key], [place & PLACE]
    t = t.filter(pc.invert(t["known"]))
    if t.num_rows:
        h, key, place = unpacked(t, *ANCHORS)
        order = np.lexsort((key, h))
        h, key, place = h[order], key[order], place[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.r_[starts, len(h)])
        shared = np.repeat((key[starts] != key[starts + sizes - 1]) | np.logical_or.reduceat(place < 0, starts), sizes)
        keys, places = [*keys, key[shared]], [*places, place[shared] & PLACE]
    return pa.table({"text_key": np.concatenate(keys), "place": np.concatenate(places)})


WINDOWS = (["hash", "check", "doc_id", "text_key", "start"], ["<u8", "<u4", "<i8", "<i8", "<i4"])


def least_document(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows sorted by hash and document: those of the least document that has them here; and
    the others."""
    h, check, doc, *_ = columns
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (check[1:] != check[:-1])])
    least = doc == np.repeat(doc[first], np.diff(np.r_[first, len(h)]))
    return least, ~least


def later_windows(t: pa.Table) -> pa.Table:
    """Of a bucket, the windows that are known to be in a smaller document, and those that a
    smaller document has here."""
    known = t.filter(t["known"])
    docs, keys, places = [], [], []
    if known.num_rows:
        _, _, doc, key, start = unpacked(known, *WINDOWS)
        docs, keys, places = [doc], [key], [start]
    t = t.filter(pc.invert(t["known"]))
    if t.num_rows:
        columns = unpacked(t, *WINDOWS)
        order = np.lexsort((columns[2], columns[1], columns[0]))
        columns = [x[order] for x in columns]
        _, later = least_document(columns)
        docs, keys, places = ([*held, columns[k][later]] for held, k in ((docs, 2), (keys, 3), (places, 4)))
    return pa.table({"doc_id": np.concatenate(docs), "text_key": np.concatenate(keys), "start": np.concatenate(places)})


def prepared(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), F.xxhash64(F.lit(7), text).alias("text_check"), text.cast("binary").alias("data"))


def dealt_anchors(buckets: int, choose: Callable[[np.ndarray], np.ndarray], anchor: int, window: int) -> Callable[[DataFrame], DataFrame]:
    """Finds the anchors that two texts share by dealing them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(*ANCHORS, buckets, one_text)
        for b in batches:
            for key, x in zip(b.column("text_key").to_pylist(), b.column("data"), strict=True):
                words, _ = word_hashes(x.as_py())
                if len(words) < window:
                    continue
                hashes = rolled(words, anchor)
                at = choose(hashes)
                dealer.add(hashes[at], np.full(len(at), key, np.int64), at)
                if dealer.full():
                    yield from dealer.rows()
        yield from dealer.rows()

    def find(texts: DataFrame) -> DataFrame:
        dealt = texts.mapInArrow(run, Dealer(*ANCHORS, buckets, one_text).schema)
        return saved(dealt.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(shared_anchors, "text_key long, place int"))

    return find


def suspects(docs: DataFrame, find: Callable[[DataFrame], DataFrame], window: int, count: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of :func:`prepared` documents the first of each text that has suspects, ``(doc_id, text_key,
    places)``, and the others of each text, ``(doc_id, text_key, copy_of, n_words)`` (null, if not
    asked to ``count``). ``find`` makes
    a table ``(text_key, place)`` from ``(text_key, data)``. Both are tables to be dropped."""
    some = docs.where("doc_id is not null")
    shared = find(some.select("text_key", "data"))
    words = (F.regexp_count(F.col("data").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")) if count else F.lit(None)).cast("long")
    rows = saved(some.select("doc_id", "text_key", "text_check", F.octet_length("data").alias("size"), words.alias("n_words")))
    texts = saved(rows.where(F.col("size") >= 2 * window - 1).groupBy("text_key", "text_check").agg(F.min("doc_id").alias("first_doc_id")))
    copies = saved(rows.join(texts, ["text_key", "text_check"]).where("doc_id > first_doc_id").select("doc_id", "text_key", F.col("first_doc_id").alias("copy_of"), "n_words").distinct())
    spots = saved(shared.groupBy("text_key").agg(F.collect_list("place").alias("places")).join(texts, "text_key").select(F.col("first_doc_id").alias("doc_id"), "text_key", "places"))
    drop(shared, rows, texts)
    return spots, copies


def suspect_windows(docs: DataFrame, spots: DataFrame, anchor: int, window: int, schema: str, sink: Callable[[], object]) -> DataFrame:
    """All windows that hold a suspect, as columns ``hash, check, doc_id, text_key, start`` added
    to a ``Dealer`` (or what is like one) of each task's own, which ``sink`` makes."""
    reach = window - anchor + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = sink()
        for b in batches:
            for doc, key, x, places in zip(b.column("doc_id").to_pylist(), b.column("text_key").to_pylist(), b.column("data"), b.column("places"), strict=True):
                a, c = word_hashes(x.as_py())
                n = len(a) - window + 1
                if n <= 0:
                    continue
                marks = np.zeros(len(a) + 1, np.int32)
                at = places.values.to_numpy()
                marks[at[at < len(a)] + 1] = 1
                marks = np.cumsum(marks)
                start = np.flatnonzero(marks[np.minimum(np.arange(n) + reach, len(a))] > marks[:n])
                dealer.add(rolled(a, window)[start], rolled(c, window)[start] >> np.uint64(32), np.full(len(start), doc, np.int64), np.full(len(start), key, np.int64), start)
                if dealer.full():
                    yield from dealer.rows()
        yield from dealer.rows()

    found = docs.join(spots.withColumnsRenamed({"doc_id": "spot_doc", "text_key": "spot_key"}), (F.col("doc_id") == F.col("spot_doc")) & (F.col("text_key") == F.col("spot_key")))
    return found.select("doc_id", "text_key", "data", "places").mapInArrow(run, schema)


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows that start at ``starts`` cover."""
    change = np.zeros(n_words + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + window, n_words), -1)
    return np.cumsum(change[:-1]) > 0
