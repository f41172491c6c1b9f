"""Hard negatives by a vector-approximation file.

Vectors are dealt into groups and cut into blocks. In each block every dimension is quantised into at most
``CELLS`` cells of about equal numbers of vectors, so a vector is one byte a dimension, and a cell is
known by its least and greatest value. For an anchor, a table has the least and the greatest product of
its component with each cell; looked up and summed over the dimensions, they bound the score of every
vector of the block from below and above. Only vectors that can still enter are scored exactly.

1. Positives: of an anchor's own label, a vector can be among the first ``POSITIVES`` if its upper bound
   reaches the greatest lower bounds met so far in its group, as many as are wanted.
2. Negatives: of other labels, a vector can be in the window of a positive if its bounds reach into it,
   and if its upper bound reaches the greatest lower bounds of those that lie in the window for certain.

Each group returns its first few; a window over the groups ranks the whole. Anchors (a stated query set) go
in batches to every group, which holds its blocks (at most ``GROUP`` vectors) while the batches pass by:
vectors are moved once, and no pair of rows is.

Rows with equal vectors and labels are classes. Of each, only as many ids as a result can hold, and one
more (an anchor is not its own candidate), take part, the smallest; so a group of copies of any size is a few rows.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part; rows
that are equal count once; rows that repeat an id with another label or vector are each a candidate, and as
an anchor the least of (label, vector) counts; a candidate is any row with another id than the anchor's;
vectors of fewer components count as if padded with zeros; ties go to the smaller id; scores beyond 64
bits are cut to the nearest 64-bit number; an empty table gives an empty table; other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, drop, parallelism, saved
from .topk import _arrays, _fit, _pack

SCALE = 256
ANCHOR_EVERY = 100
#: Positives of an anchor, negatives of a positive, and the window's floor in hundredths of the positive's score.
POSITIVES, NEGATIVES, FLOOR = 5, 5, 80
#: Cells of a dimension (at most 256: one byte), vectors of a block and of a group, anchors of a batch.
CELLS = 64
BLOCK = 8192
GROUP = 32 * BLOCK
BATCH = 1024
#: Bounds, and exact scores, that are made at once.
AT_ONCE, PAIRS = 1 << 21, 1 << 16
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximations of a block (dimensions by vectors), and the least and greatest value of each
    cell (dimensions by cells)."""
    n, width = vectors.shape
    codes = np.zeros((width, n), np.uint8)
    least, most = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
    cuts = np.arange(1, cells) * n // cells
    for d in range(width):
        x = vectors[:, d]
        ordered = np.sort(x)
        bounds = np.unique(ordered[cuts])  # a cell begins at each
        codes[d] = np.searchsorted(bounds, x, side="right")
        starts = np.r_[0, np.searchsorted(ordered, bounds, side="left")]
        ends = np.r_[starts[1:], n]
        some = ends > starts
        least[d, : len(starts)][some] = ordered[starts[some]]
        most[d, : len(starts)][some] = ordered[ends[some] - 1]
    return codes, least, most


class Block:
    """A block's approximations and vectors, in the order of their labels."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, codes: np.ndarray, least: np.ndarray, most: np.ndarray):
        self.ids, self.labels, self.vectors, self.codes, self.least, self.most = ids, labels, vectors, codes, least, most
        self.size = max(1, int(np.abs(least).max(initial=0)), int(np.abs(most).max(initial=0)))

    def bounds(self, anchors: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each anchor with the vectors from ``a`` to ``b``."""
        width = len(self.codes)
        reach = float(max(1, int(np.abs(anchors).max(initial=0)))) * self.size * width
        kind = np.int32 if reach < 1 << 31 else np.int64 if reach < 1 << 62 else np.float64
        low, high = np.zeros((len(anchors), b - a), kind), np.zeros((len(anchors), b - a), kind)
        looked = np.empty_like(low)
        for d in range(width):
            q = anchors[:, d : d + 1].astype(kind)
            one, two = q * self.least[d].astype(kind), q * self.most[d].astype(kind)
            code = self.codes[d, a:b]
            low += np.take(np.minimum(one, two), code, axis=1, out=looked, mode="clip")
            high += np.take(np.maximum(one, two), code, axis=1, out=looked, mode="clip")
        if kind is np.float64:  # sums are rounded: wider bounds
            low, high = (np.clip(x, -(2.0**63), 2.0**63) for x in (low - reach * 2.0**-40, high + reach * 2.0**-40))
        return low, high

    def scores(self, anchors: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        width = len(self.codes)
        exact = max(1, int(np.abs(anchors).max(initial=0))) * self.size * width < 1 << 63
        out = np.empty(len(rows), np.int64)
        for k in range(0, len(rows), PAIRS):
            x, y = anchors[rows[k : k + PAIRS], :width], self.vectors[places[k : k + PAIRS]]
            out[k : k + PAIRS] = np.einsum("ij,ij->i", x, y) if exact else [min(max(int(s), _LEAST), _MOST) for s in (x.astype(object) * y.astype(object)).sum(axis=1)]
        return out


def _raised(floors: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The greatest of both, in rows of as many as ``floors`` has."""
    k = floors.shape[1]
    return np.partition(np.concatenate((floors, values.astype(floors.dtype)), axis=1), -k, axis=1)[:, -k:]


def _first(keys: list[np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k`` of each key: greater scores, then smaller ids."""
    if not len(ids):
        return np.zeros(0, np.int64)
    order = np.lexsort((ids, ~scores, *keys[::-1]))  # (~s falls as s rises, whatever the bits)
    new = np.any([np.r_[True, x[order][1:] != x[order][:-1]] for x in keys], axis=0)
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[place < k]


def _alike(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for x in np.unique(labels):
        yield int(x), np.flatnonzero(labels == x)


def _parts(anchors: int, ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    step = max(1, AT_ONCE // max(1, anchors))
    for a, e in ranges:
        for k in range(a, e, step):
            yield k, min(e, k + step)


def positives(ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, blocks: list[Block], k: int = POSITIVES) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each anchor its first ``k`` of the blocks' rows of its label: ``(row of anchor, id, score)``,
    and the number of exact scores."""
    rows, found, points, scored = [], [], [], 0
    for label, own in _alike(labels):
        floors = np.full((len(own), k), float("-inf"))
        q = anchors[own]
        for block in blocks:
            begin, end = (int(np.searchsorted(block.labels, label, side=side)) for side in ("left", "right"))
            for a, e in _parts(len(own), [(begin, end)]):
                low, high = block.bounds(q, a, e)
                self_ = block.ids[a:e][None, :] == ids[own][:, None]
                floors = _raised(floors, np.where(self_, float("-inf"), low))
                x, y = np.nonzero((high >= floors.min(axis=1)[:, None]) & ~self_)
                scored += len(x)
                rows.append(own[x])
                found.append(block.ids[a + y])
                points.append(block.scores(q, x, a + y))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    r, i, s = np.concatenate(rows), np.concatenate(found), np.concatenate(points)
    best = _first([r], i, s, k)
    return r[best], i[best], s[best], scored


def window_floor(score: np.ndarray, floor: int = FLOOR) -> np.ndarray:
    """The least score in the window of each positive score."""
    return np.array([max(-((-floor * int(s)) // 100), _LEAST) for s in score.ravel()], np.int64).reshape(score.shape)


def negatives(ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, wanted: np.ndarray, have: np.ndarray, blocks: list[Block], k: int = NEGATIVES, floor: int = FLOOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each anchor and each of its ``have`` positives, whose scores are ``wanted``, the first ``k`` of
    the blocks' rows of other labels in the positive's window: ``(row of anchor, place of positive, id,
    score)``, and the number of exact scores."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    scored = 0
    bottoms = window_floor(wanted, floor)
    for label, own in _alike(labels):
        q, tops, bottom = anchors[own], wanted[own], bottoms[own]
        live = np.arange(wanted.shape[1])[None, :] < have[own][:, None]
        floors = np.full((wanted.shape[1], len(own), k), float("-inf"))
        for block in blocks:
            begin, end = (int(np.searchsorted(block.labels, label, side=side)) for side in ("left", "right"))
            for a, e in _parts(len(own), [(0, begin), (end, len(block.labels))]):
                low, high = block.bounds(q, a, e)
                self_ = block.ids[a:e][None, :] == ids[own][:, None]
                can = np.zeros(low.shape, bool)
                for j in range(wanted.shape[1]):
                    least, most = bottom[:, j : j + 1], tops[:, j : j + 1]
                    sure = (low >= least) & (high <= most) & ~self_
                    if sure.any():
                        floors[j] = _raised(floors[j], np.where(sure, low, float("-inf")))
                    can |= (low <= most) & (high >= least) & (high >= floors[j].min(axis=1)[:, None]) & live[:, j : j + 1]
                x, y = np.nonzero(can & ~self_)
                scored += len(x)
                s = block.scores(q, x, a + y)
                for j in range(wanted.shape[1]):
                    inside = live[x, j] & (bottom[x, j] <= s) & (s <= tops[x, j])
                    for held, column in zip(out, (own[x[inside]], np.full(int(inside.sum()), j), block.ids[a + y[inside]], s[inside]), strict=True):
                        held.append(column)
    if not out[0]:
        return *(np.zeros(0, np.int64) for _ in range(4)), 0
    r, j, i, s = (np.concatenate(x) for x in out)
    best = _first([r, j], i, s, k)
    return r[best], j[best], i[best], s[best], scored


def prepared(embeddings: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v)`` of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    good = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def approximations(rows: DataFrame, groups: int, cells: int = CELLS) -> DataFrame:
    """The file: ``(group, ids, label, data, width, codes, least, most)``, a row for each block, to be dropped."""
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("vec_id", "label"), F.lit(groups)).cast("int"))
    blocks = _pack(dealt.repartitionById(groups, "bucket").sortWithinPartitions("bucket", "label", "vec_id").select("vec_id", "v", "label", "bucket"), BLOCK, key="bucket", more=("label",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                (m,) = _arrays(b, r, {"data": b.column("width")[r].as_py()})
                columns = [pa.array([x.tobytes()], pa.binary()) for x in quantised(m, cells)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("number")[r].as_py()], pa.int32()), *[b.column(c).slice(r, 1) for c in ("ids", "label", "data", "width")], *columns], names=["group", "ids", "label", "data", "width", "codes", "least", "most"])

    return saved(blocks.mapInArrow(run, "group int, ids binary, label binary, data binary, width int, codes binary, least binary, most binary"))


def _block(b: pa.RecordBatch, r: int) -> Block:
    width = b.column("width")[r].as_py()
    ids, labels, data = _arrays(b, r, {"ids": 0, "label": 0, "data": width})
    codes = np.frombuffer(b.column("codes")[r].as_py(), np.uint8).reshape(width, -1)
    least, most = (np.frombuffer(b.column(c)[r].as_py(), np.int64).reshape(width, -1) for c in ("least", "most"))
    return Block(ids, labels, data, codes, least, most)


def _passed(file: DataFrame, batches: DataFrame, groups: int, more: tuple[str, ...], search: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``search(ids, labels, vectors, blocks, *more)`` of every batch in every group."""
    kept = file.withColumn("kind", F.lit(0))
    sent = batches.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1))
    both = kept.unionByName(sent.drop("number"), allowMissingColumns=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, blocks = None, []
        for b in it:
            for r in range(b.num_rows):
                if b.column("group")[r].as_py() != group:
                    group, blocks = b.column("group")[r].as_py(), []
                if not b.column("kind")[r].as_py():
                    blocks.append(_block(b, r))
                elif blocks:
                    width = b.column("width")[r].as_py()
                    ids, labels, vectors, *rest = _arrays(b, r, {"ids": 0, "label": 0, "data": width} | dict.fromkeys(more, 0))
                    yield search(ids, labels, _fit(vectors, max([width, *(len(x.codes) for x in blocks)])), blocks, *rest)

    return both.repartitionById(groups, "group").sortWithinPartitions("group", "kind").mapInArrow(run, schema)


def _batches(anchors: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Anchors of the same label stand together."""
    dealt = anchors.repartitionByRange(parallelism(anchors.sparkSession), "label", "vec_id").sortWithinPartitions("label", "vec_id")
    return _pack(dealt.select("vec_id", "v", "label", *more), BATCH, more=("label", *more))


def mine(embeddings: DataFrame, anchor: Column, label: Column, scale: int = SCALE, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, floor: int = FLOOR, cells: int = CELLS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. ``anchor`` is a
    condition on ``vec_id``, ``label`` an expression of the table's columns."""
    rows = prepared(embeddings, label, scale)
    groups = max(parallelism(rows.sparkSession), -(-embeddings.count() // GROUP))
    chosen = rows.where(anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x"))
    anchors = saved(chosen.select("vec_id", "x.label", "x.v"))
    # (the limit on the place is applied in each task before rows are dealt out)
    place = F.row_number().over(Window.partitionBy("label", "key", "v").orderBy("vec_id"))
    classes = rows.distinct().withColumn("key", F.xxhash64("v")).withColumn("place", place).where(F.col("place") <= max(n_positives, n_negatives) + 1)
    file = approximations(classes.select("vec_id", "label", "v"), groups, cells)

    def near(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, blocks: list[Block]) -> pa.RecordBatch:
        row, found, score, _ = positives(ids, labels, vectors, blocks, n_positives)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)], names=["anchor_id", "positive_id", "positive_score"])

    met = _passed(file, _batches(anchors), groups, (), near, "anchor_id long, positive_id long, positive_score long")
    first = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    best = saved(met.withColumn("place", first - 1).where(F.col("place") < n_positives))
    scores = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # n_positives at most
    names = [f"p{k}" for k in range(n_positives)]
    wanted = anchors.join(scores, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "v", "label", F.size("p").alias("have"), *[F.coalesce(F.get("p", k)["positive_score"], F.lit(0)).alias(n) for k, n in enumerate(names)])

    def hard(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, blocks: list[Block], have: np.ndarray, *tops: np.ndarray) -> pa.RecordBatch:
        row, at, found, score, _ = negatives(ids, labels, vectors, np.stack(tops, axis=1), have, blocks, n_negatives, floor)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(at, pa.int32()), pa.array(found), pa.array(score)], names=["anchor_id", "place", "negative_id", "negative_score"])

    seen = _passed(file, _batches(wanted, ("have", *names)), groups, ("have", *names), hard, "anchor_id long, place int, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = seen.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    out = checkpointed(ranked.join(best, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    drop(anchors, file, best)
    return out
