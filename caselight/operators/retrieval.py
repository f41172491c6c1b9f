"""Keyword retrieval for a table of queries, by an inverted index.

Chunks are numbered within shards of about ``SHARD`` chunks; the index has a row for each shard and word: the
word's posting list, the sorted numbers of the shard's chunks that hold it. It is made by one shuffle, can be
written and read again (``write``, ``read``), and grows with the text alone.

A query goes to every shard, which holds the posting lists of the words that some query asks for, and
takes its words rarest first. A chunk that has held none of the first words can at most hold the rest: once
these are too few for the least share, or for the ``k``-th best share so far, no new chunk is taken up, and
the longer lists are only looked up for chunks that can still get there. Each shard returns its first
``k``, and a window over the shards ranks the whole. So no chunk meets a query for which it can't matter, and
the most frequent words, which a third of all chunks may hold, are never joined row by row.

Scores are shares of a query's distinct words, three digits; equal ones go by document and chunk.

Defined results: null texts have no chunks with words; queries without words find nothing; null query ids
are left out, and equal ids are one query of the words of all; chunks equal in document, place and words count once; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caselight.functions import text
from caselight.functions.text import rounded, text_of

SHARD = 65_536
CHUNK_CHARS = 800
K, LEAST, TERMS, SNIPPET = 8, 0.15, 6, 300
#: Queries that a shard is given at once.
BATCH = 256


def chunked(docs: DataFrame, chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, chunk_index, chunk``: the whole text in pieces of ``chars`` characters."""
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("_whole") / chars).cast("int") - 1, F.lit(0)))
    rows = docs.select("doc_id", text_of("text").alias("_whole")).select("doc_id", "_whole", F.explode(pieces).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substring("_whole", F.col("chunk_index") * chars + 1, F.lit(chars)).alias("chunk"))


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards_for(chunks: DataFrame) -> int:
    return max(_tasks(chunks.sparkSession), -(-chunks.count() // SHARD))


def index(chunks: DataFrame, shards: int | None = None) -> DataFrame:
    """``shard, word, numbers, docs, places``: posting lists. Beside the word '' stand the documents and places
    of all chunks of the shard, in the order of their numbers."""
    shards = shards or shards_for(chunks)
    keyed = chunks.select(F.pmod(F.xxhash64("doc_id", "chunk_index", "chunk"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "chunk_index", F.array_distinct(text.tokens(F.col("chunk"))).alias("words")).distinct()
    number = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id", "chunk_index")) - 1
    numbered = keyed.withColumn("number", number)
    # the keys of a shard's chunks stand beside the word ''
    words = F.explode(F.concat(F.array(F.lit("")), F.col("words")))
    rows = numbered.select("shard", "number", words.alias("word"), "doc_id", "chunk_index")
    own = F.when(F.col("word") == "", F.struct("number", "doc_id", "chunk_index")).otherwise(F.struct("number", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("chunk_index")))
    lists = rows.groupBy("shard", "word").agg(F.array_sort(F.collect_list(own)).alias("x"))
    only = F.col("word") == ""
    return lists.select("shard", "word", F.col("x.number").alias("numbers"), F.when(only, F.col("x.doc_id")).alias("docs"), F.when(only, F.col("x.chunk_index")).alias("places"))


def write(found: DataFrame, path: str) -> None:
    """An index, a shard's words together and in order."""
    found.repartition(_tasks(found.sparkSession), "shard").sortWithinPartitions("shard", "word").write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def best_of(lists: list[np.ndarray], asked: int, size: int, k: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The chunks that can be among the first ``k``, by posting lists of a query of ``asked`` words: their numbers
    and how many of the words each holds; and the list entries that were read in full."""
    lists = sorted(lists, key=len)
    share = lambda hits: np.floor(hits / asked * 1000 + 0.5)
    held = np.zeros(size, np.int32)
    need, seen, read_ = int(np.floor(least * asked + 1e-9)) + 1, 0, 0
    floor = 0.0  # of the k-th best share so far
    for seen, numbers in enumerate(lists):  # noqa: B007
        rest = len(lists) - seen
        if rest < need or share(rest) < floor:
            break
        held[numbers] += 1
        read_ += len(numbers)
        some = held[held > 0]
        if len(some) >= k:
            floor = max(floor, float(share(np.partition(some, -k)[-k])))
    else:
        seen = len(lists)
    for at in range(seen, len(lists)):
        rest = len(lists) - at
        alive = np.flatnonzero(held)
        alive = alive[(held[alive] + rest >= need) & (share(held[alive] + rest) >= floor)]
        if not len(alive):
            return alive, alive.astype(np.int32), read_
        fresh = np.zeros(size, np.int32)
        fresh[alive] = held[alive]
        places = np.searchsorted(lists[at], alive)
        places[places == len(lists[at])] = 0
        fresh[alive] += lists[at][places] == alive
        held = fresh
        if len(alive) >= k:
            floor = max(floor, float(share(np.partition(held[alive], -k)[-k])))
    found = np.flatnonzero(held >= need)
    return found, held[found], read_


def search(found: DataFrame, queries: DataFrame, k: int = K, least: float = LEAST, shards: int | None = None) -> DataFrame:
    """``query_id, rank, doc_id, chunk_index, score``: for each of ``queries(query_id, text)`` the first ``k``
    chunks of an index that hold more than a share of ``least`` of its words. The number of ``shards``, if
    known, saves a look at the index."""
    spark = found.sparkSession
    words = queries.where("query_id is not null").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(text.tokens(F.col("text"))))).alias("words")).where(F.size("words") > 0)
    asked = words.select(F.explode("words").alias("word")).distinct().unionByName(spark.range(1).select(F.lit("").alias("word")))
    lists = found.join(asked, "word", "left_semi").withColumn("kind", F.when(F.col("word") == "", 0).otherwise(1))
    batches = words.groupBy(F.pmod(F.xxhash64("query_id"), F.ceil(F.lit(words.count()) / BATCH) + 1).alias("batch")).agg(F.collect_list("query_id").alias("ids"), F.collect_list("words").alias("asked"))
    # a stated query set against all shards
    numbers = found.where("word = ''").select("shard") if shards is None else spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    sent = batches.join(numbers, F.lit(True), "cross").select("shard", F.lit(2).alias("kind"), "ids", "asked")
    both = lists.select("shard", "kind", "word", "numbers", "docs", "places").unionByName(sent, allowMissingColumns=True)
    kind = dict(queries.dtypes)["query_id"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, postings, docs, places = None, {}, [], []
        for b in it:
            for r in range(b.num_rows):
                if b.column("shard")[r].as_py() != shard:
                    shard, postings, docs, places = b.column("shard")[r].as_py(), {}, [], []
                if b.column("kind")[r].as_py() == 0:
                    docs, places = b.column("docs")[r].values, b.column("places")[r].values
                elif b.column("kind")[r].as_py() == 1:
                    postings[b.column("word")[r].as_py()] = b.column("numbers")[r].values.to_numpy()
                elif len(docs):
                    ids, at, hits, sizes = [], [], [], []
                    for i, w in zip(b.column("ids")[r].as_py(), b.column("asked")[r].as_py(), strict=True):
                        own = [postings[x] for x in w if x in postings]
                        numbers, held, _ = best_of(own, len(w), len(docs), k, least)
                        order = np.lexsort((numbers, -np.floor(held / len(w) * 1000 + 0.5)))[:k]  # (numbers go by document and chunk)
                        ids += [i] * len(order)
                        sizes += [len(w)] * len(order)
                        at.append(numbers[order])
                        hits.append(held[order])
                    chosen = pa.array(np.concatenate(at).astype(np.int64)) if at else pa.array([], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("ids").type.value_type), docs.take(chosen), places.take(chosen), pa.array(np.concatenate(hits).astype(np.int32) if hits else [], pa.int32()), pa.array(sizes, pa.int32())], names=["query_id", "doc_id", "chunk_index", "hits", "n"])

    dealt = both.repartition(_tasks(spark), "shard").sortWithinPartitions("shard", "kind")
    met = dealt.mapInArrow(run, f"query_id {kind}, doc_id {dict(found.dtypes)['docs'][6:-1]}, chunk_index {dict(found.dtypes)['places'][6:-1]}, hits int, n int")
    scored = met.withColumn("score", rounded(F.col("hits") / F.col("n").cast("double"), 3))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "chunk_index"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "chunk_index", "score")


def answers(hits: DataFrame, chunks: DataFrame, queries: DataFrame, terms: int = TERMS, chars: int = SNIPPET) -> DataFrame:
    """:func:`search`'s rows with the first matched ``terms``, in the query's order, and a ``snippet``. Of
    repeated chunks the least text is shown."""
    words = queries.where("query_id is not null").groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(text.tokens(F.col("text"))))).alias("words"))
    shown = hits.select("doc_id", "chunk_index").distinct().withColumnsRenamed({"doc_id": "of_doc", "chunk_index": "of_chunk"})
    texts = chunks.join(shown, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("chunk_index") == F.col("of_chunk"))).groupBy("of_doc", "of_chunk").agg(F.min("chunk").alias("chunk"))
    both = hits.join(texts, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("chunk_index") == F.col("of_chunk"))).join(words, "query_id")
    matched = F.array_intersect("words", F.array_distinct(text.tokens(F.col("chunk"))))
    return both.select("query_id", "rank", "doc_id", "chunk_index", "score", F.array_join(F.slice(matched, 1, terms), ",").alias("terms"), F.substring("chunk", 1, chars).alias("snippet"))
