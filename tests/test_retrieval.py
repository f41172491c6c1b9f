"""The inverted index against a scan of all chunks for each query."""

import math
import random
import re

import numpy as np
import pytest

from caselight.operators import retrieval


def words(t):
    return list(dict.fromkeys(w for w in re.sub(r"[^a-z0-9 ]", " ", (t or "").lower()).split() if len(w) > 2))


def plain(chunks, queries, k, least):
    out = []
    for q, t in queries:
        asked = words(t)
        hits = []
        for d, c, x in set(chunks):
            share = len(set(asked) & set(words(x))) / max(len(asked), 1)
            if share > least:
                hits.append((-math.floor(share * 1000 + 0.5) / 1000, (d is not None, d or 0), c, d))
        out += [(q, r, d, c, -s) for r, (s, _, c, d) in enumerate(sorted(hits, key=lambda h: h[:3])[:k], 1)]
    return sorted(out, key=str)


def made(n, seed):
    r = random.Random(seed)
    rare = [f"word{k}" for k in range(400)]
    some = lambda m: " ".join(r.choice(rare) if r.random() < 0.6 else r.choice(["the", "and", "common", "often"]) for _ in range(m))
    chunks = [(d, c, some(r.randrange(2, 30))) for d in range(n) for c in range(r.randrange(1, 4))]
    queries = [(q, " ".join(r.sample(r.choice(chunks)[2].split() + some(4).split(), 4))) for q in range(30)]
    return chunks, queries


@pytest.mark.parametrize("k, least, shards", [(8, 0.15, 5), (2, 0.5, 1), (3, 0.0, 40)])
def test_scan(spark, k, least, shards):
    chunks, queries = made(150, k)
    chunks += [(0, 9, None), (None, 0, "the common word1 word2"), chunks[3], chunks[3]]
    queries += [(100, ""), (101, None), (102, "no such thing"), (103, "the and common often")]
    df = spark.createDataFrame(chunks, "doc_id long, chunk_index int, chunk string")
    asked = spark.createDataFrame([*queries, (None, "the")], "query_id long, text string")
    got = retrieval.search(retrieval.index(df, shards), asked, k, least)
    assert got.columns == ["query_id", "rank", "doc_id", "chunk_index", "score"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == plain(chunks, queries, k, least)


def test_kept_index_and_answers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 100 + "delta"), (2, "beta"), (3, None), (4, "")], "doc_id long, text string")
    chunks = retrieval.chunked(docs)
    assert "".join(r["chunk"] for r in chunks.where("doc_id = 1").orderBy("chunk_index").collect()) == "alpha beta gamma " * 100 + "delta"
    retrieval.write(retrieval.index(chunks), str(tmp_path / "index"))
    queries = spark.createDataFrame([(7, "Delta, beta! alpha")], "query_id long, text string")
    hits = retrieval.search(retrieval.read(spark, str(tmp_path / "index")), queries)
    rows = retrieval.answers(hits, chunks, queries).orderBy("rank").collect()
    assert [(r["doc_id"], r["chunk_index"], r["score"], r["terms"]) for r in rows] == [(1, 2, 1.0, "delta,beta,alpha"), (1, 0, 0.667, "beta,alpha"), (1, 1, 0.667, "beta,alpha"), (2, 0, 0.333, "beta")]
    assert all(len(r["snippet"]) <= retrieval.SNIPPET for r in rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, chunk_index int, chunk string")
    asked = spark.createDataFrame([(1, "word")], "query_id long, text string")
    assert retrieval.search(retrieval.index(none), asked).collect() == []
    assert retrieval.search(retrieval.index(spark.createDataFrame([(1, 0, "word")], none.schema)), asked.limit(0)).collect() == []


def test_long_lists_are_not_read():
    g = np.random.default_rng(1)
    hot = [np.arange(50_000), np.sort(g.choice(50_000, 30_000, replace=False))]
    rare = [np.sort(g.choice(50_000, 40, replace=False)) for _ in range(6)]
    same = [np.unique(np.r_[x, np.arange(20)]) for x in rare]  # 20 chunks hold all rare words
    found, held, read = retrieval.best_of(same + hot, 8, 50_000, 8, 0.15)
    assert read < 1000 and set(range(20)) >= set(found[held >= 7].tolist())
