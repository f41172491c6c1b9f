"""Queries over the inverted index, and stemmed overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselight.functions import text
from caselight.operators import evaluation, retrieval, summary
from caselight.session import spread

from .cases import d, r, table
from .q_text import _pairs, toks

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            SQL[name] = oracle
        return f

    return put


_C = retrieval.CHUNK_CHARS


@query("rag_batch", f"""WITH c AS MATERIALIZED (SELECT doc_id, i AS chunk_index, chunk, list_distinct({toks('chunk')}) AS w FROM (SELECT doc_id, i, substr(t, i * {_C} + 1, {_C}) AS chunk FROM (SELECT doc_id, t, unnest(range(0, greatest(CAST(ceil(length(t) / {_C}) AS INTEGER), 1))) AS i FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))),
q AS MATERIALIZED (SELECT item_id, {toks('text')} AS l FROM benchmark), u AS MATERIALIZED (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS w FROM q),
s AS (SELECT item_id, doc_id, chunk_index, chunk, u.w AS qw, c.w AS cw, len(list_intersect(u.w, c.w)) / CAST(len(u.w) AS DOUBLE) AS share FROM u JOIN c ON len(list_intersect(u.w, c.w)) / CAST(len(u.w) AS DOUBLE) > {d(retrieval.LEAST)}),
n AS (SELECT *, {r('share', 3)} AS score, row_number() OVER (PARTITION BY item_id ORDER BY {r('share', 3)} DESC, doc_id, chunk_index) AS rank FROM s)
SELECT item_id AS query_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, score, array_to_string(list_filter(qw, lambda x: list_contains(cw, x))[1:{retrieval.TERMS}], ',') AS terms, substr(chunk, 1, {retrieval.SNIPPET}) AS snippet FROM n WHERE rank <= {retrieval.K}""")
def rag_batch(spark, sf):
    """Every benchmark text against all chunks of all documents."""
    chunks = retrieval.chunked(table(spark, sf, "documents"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    shards = retrieval.shards_for(chunks)
    return retrieval.answers(retrieval.search(retrieval.index(chunks, shards), queries, shards=shards), chunks, queries)


@query("rouge_stemmed")
def rouge_stemmed(spark, sf):
    """ROUGE-1, -2 and -L of stemmed words, for pairs of benchmark texts."""
    return evaluation.rouge_stemmed(_pairs(spark, sf))


@query("rouge_documents")
def rouge_documents(spark, sf):
    """Means over all documents of over 80 characters: their best sentences against their first three."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text").where(F.length("text") > 80))
    lead = F.array_join(F.slice(text.sentences(F.col("text"), 20), 1, 3), " ")
    pairs = summary.leading_by_score(docs.select("doc_id", "text", lead.alias("reference")))
    return evaluation.batch_mean(evaluation.rouge_stemmed(pairs.select(F.col("doc_id").alias("id"), F.col("summary").alias("hypothesis"), "reference")))
