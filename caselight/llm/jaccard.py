"""Near duplicates: SimHash with pivot distance tables links them, as in op5, the exact Jaccard
similarity of the sets of word shingles confirms the links, and an exact way finds the rest.

Texts whose sets are equal are one node, with the SimHash fingerprint of its set. First, sets of any
size meet as in op5: fingerprints that agree in four of ten segments, which loses no pair within
``LINK_BITS``; the pivot tables discard, the bits confirm. What they link is confirmed on the texts.

The rest: at a similarity of 0.8 each of 64 bits differs with probability 0.152, so many similar sets
are further apart than any radius that segments or pivots can select by. Every node therefore
orders its shingles in the same way (by hash, those that a sample shows to be common last) and is filed
under the first ``n - ceil(s n) + 1`` of them: two sets of similarity ``s`` share one of these at
least, so no pair is lost, whatever the order. A pair that meets is passed over if SimHash and the
rounds before have put it in one component, and discarded if its sizes, or what is left behind the
shared shingle in either order, rule out ``s``; or, in sets of ``SURE`` shingles and more, if the
fingerprints differ in more than ``MOST_BITS`` (at a similarity of 0.8 with probability 1.9e-7). What
is left is held against the sets' histograms by the hashes' first byte: sets share no more than the
sum of the smaller counts. Survivors are confirmed on their texts.

Pairs of the rest are met and confirmed in three rounds, so that large groups of near copies do not
make all their pairs: neighbours by size under each shingle; then, from the shingles with more than
two nodes, each node's most alike of another component; then all pairs whose components still differ.

Defined results: null text has no words; texts without words are alike; a text of fewer words than a
shingle is one shingle; rows without ``doc_id`` link others but are never left out; rows that share
the least ``doc_id`` of their component all stay; an empty table gives an empty table; extra columns
are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, drop, first_of_each, parallelism, saved
from .components import connected_components
from .simhash import link_tasks, near_links

SHINGLE_WORDS = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
SEED = 42
#: Bits within which fingerprints are linked, and the segments that they meet by.
LINK_BITS = 6
SEGMENTS = (6, 6, 6, 6, 6, 6, 7, 7, 7, 7)
#: Bits in which fingerprints of similar sets of at least ``SURE`` shingles differ at most.
MOST_BITS = 26
SURE = 64
#: One text in so many is sampled for common shingles; one is common that so many of these hold.
SAMPLE = 50
COMMON = 4
#: Common shingles that are put last.
MOST_COMMON = 100_000
#: Pairs whose histograms are compared at once.
PAIRS_AT_ONCE = 1 << 16
#: Filed rows that a task takes.
TASK_ROWS = 1_000_000

_SETS = "doc_id long, text_key long, set_key long, n int, fp long, histogram binary, prefix array<long>"


def shingles(data: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8."""
    tokens = data.lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: len(tokens) - words].tolist()]
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64))


def set_fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        count += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes)).view(np.int64)[0])


def histogram(hashes: np.ndarray) -> bytes:
    """How many hashes have each first byte; 255 stands for more as well."""
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Which pairs of histograms (rows of two matrices) of sets of so many shingles allow it."""
    shared = np.minimum(a, b)
    return (shared == 255).any(axis=1) | (shared.sum(axis=1, dtype=np.int64) * (least[0] + least[1]) >= least[0] * (n_a + n_b))


def alike(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=1, dtype=np.int64) / (n_a + n_b)


def similar(a: np.ndarray, b: np.ndarray, least: tuple[int, int] = SIMILAR) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least[1] >= (len(a) + len(b) - both) * least[0]


def prefix(hashes: np.ndarray, common: np.ndarray, least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """The shingles that a set is filed under, in order; ``common`` is sorted."""
    n = len(hashes)
    if len(common) and n:
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[: n + least[0] * -n // least[1] + 1] if n else hashes


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.col("text").cast("string")).alias("text_key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"),
    )


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of the shingles that many sampled texts hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column("data"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), words).view(np.int64))], names=["h"])

    sample = _rows(docs).where(F.pmod("text_key", F.lit(SAMPLE)) == 0).select("data").mapInArrow(run, "h long")
    top = sample.groupBy("h").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "h").limit(MOST_COMMON)
    return np.sort(np.array([r["h"] for r in top.select("h").collect()], np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, common: np.ndarray, words: int, least: tuple[int, int]) -> DataFrame:
    """``(doc_id, text_key, set_key, n, fp, histogram, prefix)`` per row; where a task has met the
    set before, ``prefix`` is null."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, met = shared.value, set()
        for b in batches:
            keys, sizes, fps, counts, filed = [], [], [], [], []
            for x in b.column("data"):
                s = shingles(x.as_py(), words)
                keys.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                fps.append(set_fingerprint(s))
                counts.append(histogram(s))
                filed.append(None if keys[-1] in met else prefix(s, late, least).view(np.int64))
                met.add(keys[-1])
            made = [pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), pa.array(counts, pa.binary()), pa.array(filed, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_key"), *made], names=["doc_id", "text_key", "set_key", "n", "fp", "histogram", "prefix"])

    return _rows(docs).mapInArrow(run, _SETS)


def filed(h: np.ndarray, size: np.ndarray, node: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """``h, n, at, node, *others`` in the order of shingle and size, each node once under a shingle;
    ``size`` has ``n`` in its upper and the place of ``h`` in the node's order in its lower half."""
    order = np.lexsort((node, size >> 32, h))
    order = order[np.r_[True, (np.diff(h[order]) != 0) | (np.diff(node[order]) != 0)]] if len(order) else order
    return h[order], size[order] >> 32, size[order] & 0xFFFFFFFF, node[order], *(x[order] for x in others)


def meetings(h: np.ndarray, n: np.ndarray, at: np.ndarray, node: np.ndarray, fp: np.ndarray, root: np.ndarray, counts: np.ndarray | None = None, least: tuple[int, int] = SIMILAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``filed`` of the same ``h`` and different ``root`` that can be similar:
    neighbours by size or, with ``counts`` (the histograms), all. No row is twice on one side."""
    left, step = np.arange(len(h)), 1
    while len(left):
        left = left[left + step < len(h)]
        right = left + step
        near = (h[left] == h[right]) & (least[1] * n[left] >= least[0] * n[right])
        left, right = left[near], right[near]
        bound = np.minimum(n[left] - at[left], n[right] - at[right])
        keep = (bound * (least[0] + least[1]) >= least[0] * (n[left] + n[right])) & (root[left] != root[right])
        found_a, found_b = left[keep], right[keep]
        for k in range(0, len(found_a), PAIRS_AT_ONCE):
            a, b = found_a[k : k + PAIRS_AT_ONCE], found_b[k : k + PAIRS_AT_ONCE]
            keep = (n[a] < SURE) | (np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64)) <= MOST_BITS)
            a, b = a[keep], b[keep]
            if counts is not None:
                keep = may_be_similar(counts[a], counts[b], n[a], n[b], least)
                a, b = a[keep], b[keep]
            if len(a):
                yield a, b
        if counts is None:
            break
        step += 1


def nearest(h: np.ndarray, n: np.ndarray, at: np.ndarray, node: np.ndarray, fp: np.ndarray, root: np.ndarray, counts: np.ndarray, least: tuple[int, int] = SIMILAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each row's meetings, that with the most alike."""
    best, other = np.zeros(len(h)), np.full(len(h), -1)
    for a, b in meetings(h, n, at, node, fp, root, counts, least):
        score = alike(counts[a], counts[b], n[a], n[b])
        for x, y in ((a, b), (b, a)):
            up = score > best[x]
            best[x[up]], other[x[up]] = score[up], y[up]
    rows = np.flatnonzero(other >= 0)
    yield rows, other[rows]


def waiting(h: np.ndarray, n: np.ndarray, least: tuple[int, int] = SIMILAR) -> np.ndarray:
    """Which rows of ``filed`` have more under their shingle than neighbours."""
    near = (h[2:] == h[:-2]) & (least[1] * n[:-2] >= least[0] * n[2:])
    return np.r_[near, np.zeros(min(2, len(h)), bool)] | np.r_[np.zeros(min(2, len(h)), bool), near]


def _numbers(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    return [np.concatenate([b.column(c).to_numpy() for b in batches] or [np.zeros(0, np.int64)]) for c in names]


def _histograms(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for b in batches for x in b.column(name)), np.uint8).reshape(-1, 256)


def _unique(node: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distinct pairs of nodes, the smaller first."""
    found = [np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])], axis=1) for a, b in pairs]
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def fingerprint_links(nodes: DataFrame) -> DataFrame:
    """Distinct pairs ``(a, b)`` that connect the ``nodes(node, fp)`` whose fingerprints are within
    ``LINK_BITS`` of each other; of equal fingerprints, one node stands for all."""
    groups = saved(nodes.groupBy("fp").agg(F.min("node").alias("one")))
    fps = groups.select("fp")
    side = lambda name: groups.select(F.col("fp").alias(f"{name}_fp"), F.col("one").alias(name))
    near = saved(near_links(fps, link_tasks(fps, LINK_BITS, SEGMENTS), LINK_BITS, SEGMENTS).toDF("a_fp", "b_fp"))
    pairs = near.join(side("a"), "a_fp").join(side("b"), "b_fp").select("a", "b")
    pairs = pairs.unionByName(nodes.join(groups, "fp").where("node <> one").select(F.col("one").alias("a"), F.col("node").alias("b")))
    out = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    drop(groups, near)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The ``pairs`` whose components still differ."""
    for name in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root")), name, "left")
    return pairs.where("coalesce(a_root, a) <> coalesce(b_root, b)").select("a", "b")


def _first_round(rows: DataFrame, tasks: int, least: tuple[int, int]) -> DataFrame:
    """Pairs ``(a, b)`` of neighbours, and the rows ``(h, size, a)`` that wait for the second round
    (``b`` is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, at, node, fp = filed(*_numbers(list(batches), "h", "size", "node", "fp"))
        names = ["h", "size", "a", "b"]
        p = _unique(node, meetings(h, n, at, node, fp, node, None, least))
        none = pa.nulls(len(p), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(p[:, 0]), pa.array(p[:, 1])], names=names)
        more = waiting(h, n, least)
        yield pa.RecordBatch.from_arrays([pa.array(h[more]), pa.array(n[more] << 32 | at[more]), pa.array(node[more]), pa.nulls(int(more.sum()), pa.int64())], names=names)

    places = rows.select(F.col("set_key").alias("node"), "n", "fp", F.posexplode("prefix").alias("at", "h"))
    places = places.select("h", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("size"), "node", "fp")
    return places.repartition(tasks, "h").mapInArrow(run, "h long, size long, a long, b long")


def _later_round(rest: DataFrame, tasks: int, every: bool, least: tuple[int, int]) -> DataFrame:
    """Distinct pairs of ``rest(h, size, node, fp, root, histogram)`` whose roots differ: those of
    ``nearest`` or, with ``every``, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        numbers = _numbers(held, "h", "size", "node", "fp", "root")
        h, n, at, node, fp, root, row = filed(*numbers, np.arange(len(numbers[0])))
        p = _unique(node, (meetings if every else nearest)(h, n, at, node, fp, root, _histograms(held, "histogram")[row], least))
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return rest.repartition(tasks, "h").mapInArrow(run, "a long, b long").distinct()


def _possible(pairs: DataFrame, nodes: DataFrame, least: tuple[int, int]) -> DataFrame:
    """The ``pairs`` that the histograms of ``nodes`` allow."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("n").cast("long").alias(f"{name}_n"), F.col("histogram").alias(f"{name}_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = may_be_similar(_histograms([b], "a_h"), _histograms([b], "b_h"), *_numbers([b], "a_n", "b_n"), least)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, least: tuple[int, int]) -> DataFrame:
    """The similar ones of ``pairs``, on the texts of the ``nodes(node, first, text_key)``."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    first = needed.select("node", "first", F.col("text_key").alias("key"))
    rows = _rows(docs)
    texts = saved(rows.join(first, rows["doc_id"].eqNullSafe(first["first"]) & (rows["text_key"] == first["key"])).select("node", "data").dropDuplicates(["node"]))
    side = lambda name: texts.select(F.col("node").alias(name), F.col("data").alias(f"{name}_data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(shingles(x.as_py(), words), shingles(y.as_py(), words), least) for x, y in zip(batch.column("a_data"), batch.column("b_data"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    out = saved(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_data", "b_data").mapInArrow(run, "a long, b long"))
    drop(texts)
    return out


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, least: tuple[int, int] = SIMILAR) -> DataFrame:
    """``(doc_id, text_key, component_id)`` per row."""
    spark = docs.sparkSession
    sets = saved(shingle_sets(docs, common_shingles(docs, words), words, least))
    tasks = max(parallelism(spark), -(-int(sets.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]) // TASK_ROWS))
    rows = checkpointed(sets.select("doc_id", "text_key", "set_key"))
    one = F.min(F.struct("doc_id", "text_key", "n", "fp", "histogram")).alias("m")
    nodes = saved(sets.groupBy(F.col("set_key").alias("node")).agg(one, F.min("doc_id").alias("least_id")).select("node", F.col("m.doc_id").alias("first"), "m.text_key", "m.n", "m.fp", "m.histogram", "least_id"))
    linked = fingerprint_links(nodes)
    named = lambda rows, roots: rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tried: list[DataFrame] = []
    links: list[DataFrame] = []
    roots = spark.createDataFrame([], "node long, root long")
    for turn in range(4):
        if turn == 0:
            pairs = _possible(linked, nodes, least)
        elif turn == 1:  # what SimHash has not linked
            met = saved(_first_round(sets, tasks, least))
            drop(sets)
            waiting_rows = met.where("b is null").select("h", "size", F.col("a").alias("node")).join(nodes.select("node", "fp", "histogram"), "node")
            pairs = _possible(_apart(met.where("b is not null").select("a", "b").distinct(), roots), nodes, least)
        else:
            pairs = _later_round(named(waiting_rows, roots), tasks, turn == 3, least)
        for before in tried:  # what has been confirmed, or not, need not be met again
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        tried.append(saved(pairs))
        if not tried[-1].isEmpty():
            links.append(_confirmed(docs, nodes, tried[-1], words, least))
            roots = connected_components(reduce(DataFrame.unionByName, links))
    drop(linked, met, *tried, *links)
    # (each is written before it is joined: Spark splits a plain join's hot root or set)
    labels = saved(named(nodes.select("node", "least_id"), roots))
    least_of = saved(labels.groupBy("root").agg(F.min("least_id").alias("component_id")))
    ids = checkpointed(labels.join(least_of, "root").select(F.col("node").alias("set_key"), "component_id"))
    drop(nodes, labels, least_of)
    return rows.join(ids, "set_key").select("doc_id", "text_key", "component_id")


def keep_first(docs: DataFrame, words: int = SHINGLE_WORDS, least: tuple[int, int] = SIMILAR) -> DataFrame:
    return first_of_each(docs, near_duplicates(docs, words, least))
