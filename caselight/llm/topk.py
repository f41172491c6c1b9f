"""Exact top-k by inner product with block-at-a-time pruning.

A component and its sign make a term; a vector's weight for it is the component's size. Vectors
are put in the order of their heaviest terms and cut into blocks of a range of that order, each
with its forward index (a matrix of integers) and the least and greatest value of every
component. A query's bound for a block is the sum of its terms' maxima there. Each query takes
the blocks in falling order of bound and scores them through the forward index until the bound
falls below its kth score (a bound equal to it may still hold a tie with a smaller id).

Blocks travel in chunks of ``CHUNK`` vectors, queries in batches of ``BATCH``. What meets every batch
is only the chunks' own summed maxima, ``SUMMARIES`` chunks to a row. A query first goes to the chunk
of its greatest bound; its kth score there is a floor for all others, and it goes on to those chunks
alone whose bound reaches the floor (which a chunk's blocks are then held against as well). A window
ranks the candidates, ``k`` a query and chunk.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part. A candidate is any row with another id than the query's; where rows repeat a
query's id, the least of their vectors is the query. Vectors of fewer components count as if
padded with zeros. Scores beyond 64 bits are cut to the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, parallelism

SCALE = 1024
QUERY_EVERY = 100
K = 10
BLOCK = 64
CHUNK = 8192
BATCH = 1024
SUMMARIES = 1024
NO_FLOOR = -(1 << 63)


def scaled(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id long, v array<long>)`` of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    good = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), max(1, int(sizes.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _fit(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _exact(queries: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their products are exact."""
    most = max(1, int(np.abs(queries).max(initial=0))) * max(1, int(np.abs(docs).max(initial=0))) * queries.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object
    return queries.astype(kind), docs.astype(kind)


def bounds_of(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The greatest score that each query can have in each range of vectors."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def search(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, docs: np.ndarray, k: int = K, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of each query its best ``k`` of ``docs``, of those in blocks that can reach the query's
    ``floor``: (row of query, id, score), and the number of blocks scored."""
    width = max(queries.shape[1], docs.shape[1])
    queries, docs = _exact(_fit(queries, width), _fit(docs, width))
    n = -(-len(docs) // block)
    parts = [docs[b * block : (b + 1) * block] for b in range(n)]
    names = [ids[b * block : (b + 1) * block] for b in range(n)]
    most, least = np.array([p.max(axis=0) for p in parts]), np.array([p.min(axis=0) for p in parts])
    bounds = bounds_of(queries, most, least)
    order = np.argsort(-bounds, axis=1, kind="stable")
    worst = -(1 << 63) if docs.dtype == object else np.iinfo(np.int64).min
    best = np.full((len(queries), k), float("-inf") if docs.dtype == np.float64 else worst, docs.dtype)
    found = np.full((len(queries), k), np.iinfo(np.int64).max)
    count = np.zeros(len(queries), np.int64)
    alive, scored = np.arange(len(queries)), 0
    for step in range(n):
        at = order[alive, step]
        go = (count[alive] < k) | (bounds[alive, at] >= best[alive, k - 1])
        if floor is not None:
            go &= (bounds[alive, at] >= floor[alive]) | (floor[alive] == NO_FLOOR)
        alive, at = alive[go], at[go]  # bounds only fall: a query that stops has ended
        if not len(alive):
            break
        by = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, at[by][1:] != at[by][:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(by)], strict=True):
            rows, number = alive[by[a:b]], int(at[by[a]])
            scored += len(rows)
            score, name = queries[rows] @ parts[number].T, np.broadcast_to(names[number], (len(rows), len(names[number])))
            own = name == query_ids[rows][:, None]
            score = np.where(own, best.dtype.type(float("-inf")) if docs.dtype == np.float64 else worst, score)
            name = np.where(own, np.iinfo(np.int64).max, name)
            scores, all_names = np.concatenate((best[rows], score), axis=1), np.concatenate((found[rows], name), axis=1)
            rank = np.lexsort((all_names, -scores.astype(docs.dtype)), axis=1)[:, :k] if docs.dtype != object else np.array([sorted(range(len(s)), key=lambda j, s=s, m=m: (-s[j], m[j]))[:k] for s, m in zip(scores, all_names, strict=True)])
            best[rows], found[rows] = np.take_along_axis(scores, rank, 1), np.take_along_axis(all_names, rank, 1)
            count[rows] += (~own).sum(axis=1)
    row, place = np.nonzero(np.arange(k)[None, :] < np.minimum(count, k)[:, None])
    score = best[row, place]
    if docs.dtype == object:
        score = np.array([min(max(int(s), -(1 << 63)), (1 << 63) - 1) for s in score], np.int64)
    return row, found[row, place], score.astype(np.int64), scored


def _arrays(b: pa.RecordBatch, row: int, shapes: dict[str, int]) -> list[np.ndarray]:
    """Binary columns as numbers, in rows of so many (0: no rows)."""
    out = []
    for name, width in shapes.items():
        x = np.frombuffer(b.column(name)[row].as_py(), np.int64)
        out.append(x.reshape(-1, width) if width else x)
    return out


def _pack(rows: DataFrame, size: int, key: str | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows of up to ``size`` vectors each; a partition's rows in its order, those of one ``key``
    only. They are numbered or have the key as their number. Columns ``more`` of longs go along."""

    def packed(number: int, t: pa.Table) -> pa.RecordBatch:
        m = _matrix(t["v"])
        longs = [t[c].to_numpy().astype(np.int64).tobytes() for c in ("vec_id", *more)]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in longs), pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], names=["number", "ids", *more, "data", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, at = TaskContext.get().partitionId() << 32, [], 0, None
        for whole in batches:
            cuts = np.flatnonzero(np.diff(whole.column(key).to_numpy())) + 1 if key else []
            for a, e in zip([0, *cuts], [*cuts, whole.num_rows], strict=True):
                b = whole.slice(a, e - a)
                if key and held and b.num_rows and b.column(key)[0].as_py() != at:
                    yield packed(at, pa.Table.from_batches(held))
                    held, n = [], 0
                if not b.num_rows:
                    continue
                at = b.column(key)[0].as_py() if key else None
                held.append(b)
                n += b.num_rows
                while n >= size:
                    t = pa.Table.from_batches(held)
                    yield packed(at if key else number, t.slice(0, size))
                    held, n, number = t.slice(size).to_batches(), n - size, number + 1
        if n:
            yield packed(at if key else number, pa.Table.from_batches(held))

    return rows.mapInArrow(run, "number long, ids binary, " + "".join(f"{c} binary, " for c in more) + "data binary, width int")


def _summaries(chunks: DataFrame) -> DataFrame:
    """The greatest and least value of each component in each chunk, many chunks to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, most, least = [], [], []

        def row() -> pa.RecordBatch:
            width = max(len(x) for x in most)
            both = [np.stack([np.pad(x, (0, width - len(x))) for x in side]) for side in (most, least)]
            # a narrower chunk's vectors are zero beyond their width, as the padding is
            columns = [[np.array(numbers, np.int64).tobytes()], [both[0].tobytes()], [both[1].tobytes()], [width]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["numbers", "most", "least", "wide"])

        for b in batches:
            for r in range(b.num_rows):
                (m,) = _arrays(b, r, {"data": b.column("width")[r].as_py()})
                numbers.append(b.column("number")[r].as_py())
                most.append(m.max(axis=0))
                least.append(m.min(axis=0))
                if len(numbers) == SUMMARIES:
                    yield row()
                    numbers, most, least = [], [], []
        if numbers:
            yield row()

    return chunks.mapInArrow(run, "numbers binary, most binary, least binary, wide int")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of ``rows`` for each of ``queries``; both
    have ``vec_id`` and ``v``."""
    spark = rows.sparkSession
    heaviest = F.array_position(F.transform("v", lambda x: F.abs(x)), F.array_max(F.transform("v", lambda x: F.abs(x))))
    term = F.when(F.size("v") > 0, F.when(F.element_at("v", F.greatest(heaviest, F.lit(1)).cast("int")) < 0, -heaviest).otherwise(heaviest))
    ordered = rows.withColumn("term", term).repartitionByRange(parallelism(spark), "term", "vec_id").sortWithinPartitions("term", "vec_id")
    chunks = checkpointed(_pack(ordered.select("vec_id", "v"), CHUNK))
    asked = checkpointed(queries.groupBy("vec_id").agg(F.min("v").alias("v")))
    summaries = checkpointed(_summaries(chunks))
    groups = max(1, summaries.count())
    summaries = summaries.withColumn("group", F.pmod(F.xxhash64("numbers"), F.lit(groups)))

    def everywhere(batches: DataFrame) -> DataFrame:
        """Each batch beside each row of summaries: a stated query set against all rows, in blocks."""
        return batches.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(summaries, F.col("to") == summaries["group"])

    def bounds(b: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, q = _arrays(b, r, {"ids": 0, "data": b.column("width")[r].as_py()})
        wide = b.column("wide")[r].as_py()
        numbers, most, least = _arrays(b, r, {"numbers": 0, "most": wide, "least": wide})
        width = max(q.shape[1], wide)
        q, most, least = (_fit(x, width) for x in (q, most, least))
        exact, both = _exact(q, np.concatenate([most, least]))
        return ids, numbers, bounds_of(exact, both[: len(most)], both[len(most) :])

    def best(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                ids, numbers, bound = bounds(b, r)
                at = bound.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(numbers[at]), pa.array(bound[np.arange(len(ids)), at].astype(np.float64))], names=["query_id", "chunk", "bound"])

    def further(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                _, numbers, bound = bounds(b, r)
                floor, first = _arrays(b, r, {"floor": 0, "first": 0})
                go = ((bound >= floor[:, None]) | (floor == NO_FLOOR)[:, None]) & (numbers[None, :] != first[:, None])
                some = np.flatnonzero(go.any(axis=0))
                rows_of = [np.flatnonzero(go[:, c]).astype(np.int64).tobytes() for c in some]
                yield pa.RecordBatch.from_arrays([pa.array([b.column("number")[r].as_py()] * len(some), pa.int64()), pa.array(numbers[some], pa.int64()), pa.array(rows_of, pa.binary())], names=["batch", "chunk", "rows"])

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in range(b.num_rows):
                q_ids, q, ids, d, floor, only = _arrays(b, r, {"q_ids": 0, "q_data": b.column("q_width")[r].as_py(), "ids": 0, "data": b.column("width")[r].as_py(), "floor": 0, "rows": 0})
                if len(only):
                    q_ids, q, floor = q_ids[only], q[only], floor[only]
                row, found, points, _ = search(q_ids, q, ids, d, k, floor=floor if len(only) else None)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(found), pa.array(points)], names=["query_id", "vec_id", "score"])

    named = lambda d: d.withColumnsRenamed({"ids": "q_ids", "data": "q_data", "width": "q_width"})
    scored = "query_id long, vec_id long, score long"
    where = everywhere(_pack(asked, BATCH)).select("ids", "data", "width", "numbers", "most", "least", "wide").mapInArrow(best, "query_id long, chunk long, bound double")
    first = checkpointed(where.groupBy("query_id").agg(F.max_by("chunk", F.struct("bound", "chunk")).alias("chunk")))
    sent = asked.join(first, asked["vec_id"] == first["query_id"]).select("vec_id", "v", "chunk")
    dealt = _pack(sent.repartition(parallelism(spark), "chunk").sortWithinPartitions("chunk", "vec_id"), BATCH, key="chunk")
    nothing = F.lit(b"")
    near = named(dealt).join(chunks, "number").select("*", nothing.alias("rows"), nothing.alias("floor")).mapInArrow(score, scored)
    near = checkpointed(near)
    # a query with fewer than k candidates in its first chunk has no floor
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(NO_FLOOR)).alias("floor"))
    again = asked.join(first.join(floors, "query_id", "left").withColumnRenamed("query_id", "id"), asked["vec_id"] == F.col("id")).select("vec_id", "v", F.coalesce("floor", F.lit(NO_FLOOR)).alias("floor"), F.col("chunk").alias("first"))
    batches = checkpointed(_pack(again, BATCH, more=("floor", "first")))
    pairs = everywhere(batches).select("number", "ids", "data", "floor", "first", "width", "numbers", "most", "least", "wide").mapInArrow(further, "batch long, chunk long, rows binary")
    far = pairs.join(named(batches).withColumnRenamed("number", "batch"), "batch").join(chunks.withColumnRenamed("number", "chunk"), "chunk").mapInArrow(score, scored)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.unionByName(far).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_every(embeddings: DataFrame, every: int = QUERY_EVERY, k: int = K) -> DataFrame:
    rows = scaled(embeddings)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
