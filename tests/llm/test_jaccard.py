import random

import numpy as np
import pytest

import corpus_pipeline
from caselight.llm import jaccard, simhash
from tests.llm import brute
from tests.llm.test_dedup import SCHEMA, given, odd_rows


def shingled(text):
    w = brute.WORD.findall(brute.lower(text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_rows():
    """Copies with a growing number of words changed, on both sides of 0.8."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(6):
        text = [r.choice(words) for _ in range(120)]
        rows.append((100 * base, " ".join(text)))
        for n in range(1, 9):
            other = list(text)
            for k in r.sample(range(120), n):
                other[k] = f"x{base}-{n}-{k}"
            rows.append((100 * base + n, " ".join(other)))
    return rows


def components(rows):
    sets = [shingled(t) for _, t in rows]
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    return brute.components([i for i, _ in rows], alike)


@pytest.mark.parametrize("rows", [given(), odd_rows(), near_rows(), []], ids=["given", "odd", "near", "empty"])
def test_components(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or 0)
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()), key=key)
    assert got == sorted(zip([i for i, _ in rows], components(rows)), key=key)


def test_stage_drops_copies_of_four_fifths(spark):
    """Pairs of similarity 0.8 and more that differ in more than four bits of SimHash."""
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)["simhash_dedup"]
    kept = {r["doc_id"] for r in stage(spark, docs, "").collect()}
    assert kept == {i for (i, _), c in zip(rows, components(rows)) if i == c}
    assert len(kept) < simhash.keep_first(docs).count()


def test_common_shingles_last_lose_nothing():
    r = np.random.default_rng(4)
    common = np.unique(r.integers(0, 1 << 63, 30, np.uint64))
    for _ in range(200):
        a = np.unique(np.r_[r.choice(common, 10), r.integers(0, 1 << 63, 30, np.uint64)])
        b = np.unique(np.r_[a[r.random(len(a)) < 0.92], r.integers(0, 1 << 63, 2, np.uint64)])
        if jaccard.similar(a, b):
            rows = [np.frombuffer(jaccard.histogram(x), np.uint8)[None, :] for x in (a, b)]
            assert jaccard.may_be_similar(*rows, np.array([len(a)]), np.array([len(b)])).all()
            assert set(jaccard.prefix(a, common).tolist()) & set(jaccard.prefix(b, common).tolist())


def test_simhash_links_texts_of_any_length(spark, monkeypatch):
    """What SimHash links within the stage's bits is found without the shingle prefixes."""
    r = random.Random(23)
    rows, apart = [], {}
    for k in range(60):
        text = [r.choice("abcdefgh") + str(r.randrange(500)) for _ in range(r.choice((20, 60, 200)))]
        other = text[:-1] + [f"x{k}"] if k % 2 else [f"y{k}" if j % 50 == 7 else w for j, w in enumerate(text)]
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(other))]
        a, b = (jaccard.set_fingerprint(jaccard.shingles(t.encode())) for _, t in rows[-2:])
        apart[10 * k + 1] = ((a ^ b) % (1 << 64)).bit_count()
    exact = components(rows)
    want = [c if apart.get(i, 0) <= jaccard.LINK_BITS else i for (i, _), c in zip(rows, exact)]
    assert [i for i, _ in rows] != want != exact
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()) == sorted(zip([i for i, _ in rows], exact))
    monkeypatch.setattr(jaccard, "_first_round", lambda sets, tasks, least: spark.createDataFrame([], "h long, size long, a long, b long"))
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()) == sorted(zip([i for i, _ in rows], want))


def test_fingerprint_links_connect_all_within_bits(spark):
    r = random.Random(29)
    fps = [r.getrandbits(64) for _ in range(40)]
    fps += [x ^ sum(1 << b for b in r.sample(range(64), n)) for x in fps for n in (0, 3, 5, 6, 7)]
    nodes = [(k, f - (1 << 64) if f >> 63 else f) for k, f in enumerate(fps)]
    found = {(p["a"], p["b"]) for p in jaccard.fingerprint_links(spark.createDataFrame(nodes, "node long, fp long")).collect()}
    near = lambda i, j: (fps[i] ^ fps[j]).bit_count() <= jaccard.LINK_BITS
    assert found and all(a < b and near(a, b) for a, b in found)
    ids = list(range(len(fps)))
    assert brute.components(ids, lambda i, j: (i, j) in found or (j, i) in found) == brute.components(ids, near)


def test_pivots_discard_at_the_bits_of_the_stage():
    a, b = np.random.default_rng(3).integers(0, 1 << 63, (2, 20_000), np.uint64) * np.uint64(2)
    apart = np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max(axis=1)
    assert (apart <= jaccard.LINK_BITS).mean() < 0.01
