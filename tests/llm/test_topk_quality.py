import random

import pytest

from caselight.llm import quality, topk
from tests.llm.brute import SPACE, WORD


def brute_top(rows, k=10):
    from math import floor, isfinite

    good = [(i, [floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, qv in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors(n, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    return [(k, [c + r.gauss(0, spread) for c in r.choice(centres)]) for k in range(n)]


ODD = [(0, [1.0, -2.0]), (100, [0.5]), (1, []), (2, None), (3, [None, 1.0]), (4, [float("nan")]), (5, [float("inf")]), (6, [1.0, -2.0]), (7, [1.0, -2.0]), (6, [1.0, -2.0]), (None, [1.0]), (200, [3.0, 1.0]), (200, [2.0, 1.0]), (-100, [0.0, 0.0])]


@pytest.mark.parametrize("rows", [vectors(700, 1), ODD, [], [(0, [1.0])]], ids=["clusters", "odd", "empty", "alone"])
def test_top_k(spark, rows):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    assert sorted(tuple(r) for r in topk.search_every(df).collect()) == brute_top(rows)


def test_blocks_are_pruned():
    import numpy as np

    rows = sorted(vectors(4096, 2, 0.1), key=lambda r: r[1])
    ids, docs = np.array([r[0] for r in rows]), np.array([[int(1024 * x) for x in r[1]] for r in rows])
    row, found, score, scored = topk.search(ids[:50], docs[:50], ids, docs)
    want = np.sort(docs[:50] @ docs.T - (ids[:50, None] == ids[None, :]) * (1 << 40), axis=1)[:, ::-1][:, :10]
    assert (score.reshape(50, 10) == want).all()
    assert scored < 0.7 * 50 * (4096 // topk.BLOCK)
    big = [[10**17, -(10**17)], [10**17, 0], [1, 1]]
    _, found, score, _ = topk.search(np.array([0]), np.array(big[:1]), np.array([0, 1, 2]), np.array(big))
    assert found.tolist() == [1, 2] and score.tolist() == [(1 << 63) - 1, 0]


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    places = {}
    for k in range(len(words) - 7):
        places.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for at in places.values() if len(at) > 1 for k in at for j in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_statistics(spark):
    r = random.Random(9)
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "é 𝔘 a"), (5, "a\n\n \nb\na\na b"), (None, "x " * 40), (6, "w " * 19), (6, "w " * 19)]
    rows += [(10 + k, r.choice([" ", "\n", "\t "]).join(r.choice("abc") for _ in range(r.randint(0, 60)))) for k in range(40)]
    rows += [(60 + k, " ".join(f"w{r.randrange(40)}" for _ in range(200)) + " #| " + " ".join(f"z{k}" for k in range(30)) * 2) for k in range(10)]
    rows += [(90, "long " * 5000 + " ".join(f"u{k}" for k in range(20000)))]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_words int, _h string")
    got = [(x["rest"]["doc_id"], *x[1:]) for x in quality.statistics(df).select("rest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got, key=str) == sorted([(i, *brute_quality(t)) for i, t in rows], key=str)


def test_rules_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rules = quality.fit(docs.where("doc_id % 2 = 0"), labels)
    assert rules
    judged = quality.judged(docs.where("doc_id % 2 = 1"), rules).selectExpr("rest.doc_id", "kept", "base_failed")
    rows = judged.join(labels, "doc_id").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.6 * len(bad)


def test_no_labels_keep_all(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(30))))], "doc_id long, text string")
    for labels in ([], [(1, None)], [(None, 0)], [(1, 1)], [(1, 0)]):
        rules = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert rules == [] and quality.judged(docs, rules).first()["kept"]
    assert quality.judged(docs.where("false"), []).count() == 0


def test_a_floor_prunes_blocks_and_loses_nothing():
    import numpy as np

    r = np.random.default_rng(2)
    centres = r.normal(0, 300, (40, 16)).astype(np.int64)
    docs = np.repeat(centres, 64, axis=0) + r.integers(-20, 20, (40 * 64, 16))
    ids, queries = np.arange(len(docs)), centres[:10] + 1
    names = -1 - np.arange(10)
    row, found, score, scored = topk.search(names, queries, ids, docs, 10)
    floor = np.array([score[row == k].min() for k in range(10)])
    again = topk.search(names, queries, ids, docs, 10, floor=floor)
    assert [x.tolist() for x in again[:3]] == [row.tolist(), found.tolist(), score.tolist()] and again[3] <= scored < 400
    # a floor above all scores leaves no block; none at all is as before
    assert topk.search(names, queries, ids, docs, 10, floor=floor + 10**9)[3] == 0
    assert topk.search(names, queries, ids, docs, 10, floor=np.full(10, topk.NO_FLOOR))[3] == scored


def test_chunks_out_of_reach_are_not_met(spark, monkeypatch):
    """With small chunks: the same rows as by brute force, from several chunks and batches."""
    for name, value in (("CHUNK", 32), ("BATCH", 4), ("SUMMARIES", 3)):
        monkeypatch.setattr(topk, name, value)
    rows = vectors(900, 5, 0.2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search_every(df).collect())
    assert got == brute_top(rows)


def test_imprecise_rules_do_not_end_the_list():
    """The first seed's rule is no good; what it covered is set aside and the next one is learned."""
    r = random.Random(7)
    rows = []
    for k in range(1200):
        x = {f: r.random() for f in quality.FEATURES}
        bad = x["upper_share"] > 0.9 and r.random() < 0.99 or x["symbol_share"] > 0.7 and r.random() < 0.85
        rows.append(x | {"bad": bad, "fold": k % 3})
    rules = quality.learn(rows)
    caught = lambda x: any(all(c.holds(x) for c in rule) for rule in rules)
    clear = [x for x in rows if x["upper_share"] > 0.92]
    assert sum(map(caught, clear)) > 0.8 * len(clear)
