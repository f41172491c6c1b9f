"""Hard negatives against all pairs, and that bounds hold and spare work."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from caselight.llm import negatives

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())), StructField("label", IntegerType()), StructField("v", StringType())])


def plain(rows, every=10, k=5):
    good = {(i, n, tuple(math.floor(256 * x) for x in e)) for i, e, n in rows if i is not None and n is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    anchors = {}
    for i, n, e in good:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (n, e)), (n, e))
    out = []
    for a, (label, e) in anchors.items():
        score = lambda f, e=e: sum(x * y for x, y in zip(e, f))
        own = sorted((-score(f), i) for i, n, f in good if n == label and i != a)[:k]
        for p, i in own:
            other = sorted((-score(f), j) for j, n, f in good if n != label and j != a and 80 * -p <= 100 * score(f) <= 100 * -p)
            out += [(a, i, r, j, -p, -s) for r, (s, j) in enumerate(other[:k], 1)]
    return sorted(out)


def mined(spark, rows, every=10, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = negatives.mine(df, F.col("vec_id") % every == 0, F.col("label"), **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def vectors(n, width=12, seed=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [c + r.gauss(0, 0.7) for c in centres[r.randrange(6)]], r.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("cells", [2, 16, 256])
def test_all_pairs(spark, cells):
    rows = vectors(600)
    assert mined(spark, rows, cells=cells) == plain(rows)


def test_copies_ties_and_odd_rows(spark):
    rows = vectors(200)
    rows += [(i, rows[0][1], i % 2) for i in range(1000, 1400)]  # a third of all have one vector
    rows += [(i, [0.0] * 12, 3) for i in range(2000, 2030)]
    rows += [(50, None, 1), (60, [1.0, None], 1), (70, [math.nan] * 12, 1), (80, [math.inf] * 12, 2), (None, [1.0] * 12, 1), (90, [1.0] * 12, None), (3000, [], 1), (3010, [2.0, 1.0], 1)]
    rows += [rows[5], rows[5], (100, rows[7][1], 0), (100, rows[7][1], 1), (100, rows[8][1], 1)]
    assert mined(spark, rows) == plain(rows)


def test_batches_and_blocks_are_many(spark, monkeypatch):
    rows = vectors(500, seed=5)
    for name, value in (("BLOCK", 16), ("BATCH", 4), ("AT_ONCE", 64), ("PAIRS", 32)):
        monkeypatch.setattr(negatives, name, value)
    assert mined(spark, rows) == plain(rows)


def test_large_numbers(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) * 1e6 for _ in range(5)], i % 2) for i in range(150)]
    assert mined(spark, rows, every=5) == plain(rows, every=5)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 1), (11, [1.0], 1)]) == []
    assert mined(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)]) == [(10, 11, 1, 12, 65536, 230 * 256)]


@pytest.mark.parametrize("size", [30, 10**10, 10**17])
def test_bounds_hold(size):
    g = np.random.default_rng(4)
    vectors, anchors = g.integers(-size, size, (300, 9)), g.integers(-size, size, (20, 9))
    block = negatives.Block(np.arange(300), np.zeros(300, np.int64), vectors, *negatives.quantised(vectors, 16))
    low, high = block.bounds(anchors, 10, 250)
    exact = [[sum(int(x) * int(y) for x, y in zip(a, v)) for v in vectors[10:250]] for a in anchors]
    cut = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    assert all(low[i][j] <= cut(exact[i][j]) <= high[i][j] for i in range(20) for j in range(240))
    x, y = np.nonzero(np.ones((20, 300), bool))
    assert block.scores(anchors, x, y).tolist() == [cut(sum(int(p) * int(q) for p, q in zip(anchors[i], vectors[j]))) for i, j in zip(x, y)]


def test_few_are_scored():
    g = np.random.default_rng(7)
    vectors = np.floor(256 * (lambda m: m / np.linalg.norm(m, axis=1, keepdims=True))(g.normal(size=(8000, 64)))).astype(np.int64)
    labels = np.sort(g.integers(0, 10, 8000))
    blocks = [negatives.Block(np.arange(8000), labels, vectors, *negatives.quantised(vectors))]
    ids = np.arange(0, 8000, 100)
    row, _, score, scored = negatives.positives(ids, labels[ids], vectors[ids], blocks)
    assert scored < 0.2 * len(ids) * 800
    *_, scored = negatives.negatives(ids, labels[ids], vectors[ids], score.reshape(-1, 5), np.full(len(ids), 5), blocks)
    assert scored < 0.1 * len(ids) * 7200
