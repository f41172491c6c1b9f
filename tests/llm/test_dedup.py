import random

import pyarrow.parquet as pq
import pytest

from caselight.llm import lines, simhash, substring, suffixes
from tests.llm import brute

SCHEMA = "doc_id long, text string, fp string, keys string"
DOCS = "/root/testdata/sf0.001/documents.parquet"


def given():
    t = pq.read_table(DOCS, columns=["doc_id", "text"]).to_pydict()
    return list(zip(t["doc_id"], t["text"]))


def odd_rows():
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    r = random.Random(5)
    base = " ".join(r.choice(words) for _ in range(60))
    rows = [(None, base), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, base), (5, base), (5, base + " more"), (6, base.upper()), (7, "É" * 20 + "\nx"), (8, "É" * 20), (9, "\x0bÉ" + "É" * 19 + " "), (10, "é" * 20), (11, "A line of twenty chars\n" * 3), (12, "a LINE of twenty chars "), (13, "\ta line of twenty chars"), (None, "a line of twenty chars")]
    rows += [(20 + k, base + f" tail{k}") for k in range(40)]
    rows += [(100, base * 400)]
    return rows


@pytest.mark.parametrize("rows", [given(), odd_rows(), []], ids=["given", "odd", "empty"])
def test_simhash(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = [(r["doc_id"], f"{r['fp'] % (1 << 64):016x}", r["component_id"]) for r in simhash.near_duplicates(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = brute.simhash(rows) if not any(i is None for i, _ in rows) else sorted([(i, f"{brute.fingerprint(t):016x}", c) for (i, t), c in zip(rows, brute.components([i for i, _ in rows], lambda a, b, f=[brute.fingerprint(t) for _, t in rows]: bin(f[a] ^ f[b]).count("1") <= 4))], key=key)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_hot_groups_keep_all_links():
    import numpy as np

    r = random.Random(3)
    center = r.getrandbits(64)
    fps = {center}
    while len(fps) < 600:
        x = r.choice(sorted(fps)[:50]) if r.random() < 0.3 else center
        for _ in range(r.randint(1, 3)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    a, b = simhash.links(np.zeros(len(fps), np.int64), np.array(fps, np.uint64))
    at = {f: k for k, f in enumerate(fps)}
    found = {(at[int(x)], at[int(y)]) for x, y in zip(a, b)}
    found |= {(y, x) for x, y in found}
    assert all(bin(fps[x] ^ fps[y]).count("1") <= 4 for x, y in found)
    ids = list(range(len(fps)))
    assert brute.components(ids, lambda i, j: (i, j) in found) == brute.components(ids, lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 4)


@pytest.mark.parametrize("rows", [given(), odd_rows(), []], ids=["given", "odd", "empty"])
def test_lines(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    out = lines.dedup_lines(df).collect()
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], brute.sha(r["text"])) for r in out]
    assert sorted(got, key=str) == sorted(brute.lines(rows), key=str)
    assert all(r["fp"] == "x" and r["keys"] == "y" for r in out)


def passage_rows():
    r = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 90)))) for k in range(40)]
    for size in (12, 13, 14, 20, 49, 50, 51, 70):
        passage = " ".join(r.choice(words) for _ in range(size))
        for k in range(4):
            left, right = (" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(2))
            rows.append((200 - size - 70 * k, f"{left}\t{passage}  {right}"))
    rows += [(300 + k, " ".join(["a"] * (5 * k))) for k in range(30)]
    rows += [(None, rows[45][1]), (3, rows[41][1]), (3, rows[41][1]), (500, rows[45][1]), (501, rows[45][1] + " x"), (502, None), (503, ""), (504, " \n")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [given(), passage_rows(), []], ids=["given", "passages", "empty"])
def test_substring(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    out = substring.dedup_substrings(df).collect()
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out]
    want = [(i, len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for i, w, g in brute.windows(rows, 13)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("rows", [given(), passage_rows(), []], ids=["given", "passages", "empty"])
def test_suffixes(spark, rows):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = {}
    for r in suffixes.repeated_spans(df).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["start_word"] + r["n_words"]))
        assert r["first_doc_id"] < r["doc_id"]
    want = {}
    for i, _, gone in brute.windows(rows, suffixes.WINDOW):
        if gone:
            want.setdefault(i, set()).update(gone)
    assert got == want


def by_bucket(dealer, flushes):
    """What a dealer sends of some flushes, as a table per bucket."""
    import pyarrow as pa

    sent = []
    for columns in flushes:
        dealer.add(*columns)
        sent += dealer.rows()
    whole = pa.Table.from_batches(sent)
    return [whole.filter(pa.compute.equal(whole["bucket"], b)) for b in sorted(set(whole["bucket"].to_pylist()))]


def random_windows(seed):
    """Columns of windows of 30 documents in 6 flushes, some hashes in most documents."""
    import numpy as np

    r = np.random.default_rng(seed)
    n = 1200
    h = np.where(r.random(n) < 0.3, r.integers(0, 3, n), r.integers(0, 400, n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = r.integers(1, 31, n)
    columns = [h, (h >> np.uint64(40)) & np.uint64(0xFFFFFFFF), doc, doc * 1000 - 15_000, np.arange(n, dtype=np.int64)]
    cut = np.array_split(r.permutation(n), 6)
    return columns, [[c[k] for c in columns] for k in cut]


def test_anchors_are_shared_across_flushes():
    import numpy as np

    from caselight.llm import passages

    for seed in range(5):
        (h, _, _, key, place), flushes = random_windows(seed)
        dealer = passages.Dealer(*passages.ANCHORS, 8, passages.one_text)
        got = set()
        for t in by_bucket(dealer, [[f[0], f[3], f[4]] for f in flushes]):
            out = passages.shared_anchors(t)
            got |= set(zip(out["text_key"].to_pylist(), out["place"].to_pylist()))
        texts = {}
        for a, k in zip(h.tolist(), key.tolist()):
            texts.setdefault(a, set()).add(k)
        assert got == {(k, p) for a, k, p in zip(h.tolist(), key.tolist(), place.tolist()) if len(texts[a]) > 1}


def test_later_windows_across_flushes():
    import numpy as np

    from caselight.llm import passages

    for seed in range(5):
        (h, _, doc, key, start), flushes = random_windows(seed)
        least = {}
        for a, d in zip(h.tolist(), doc.tolist()):
            least[a] = min(least.get(a, d), d)
        want = {(d, k, s) for a, d, k, s in zip(h.tolist(), doc.tolist(), key.tolist(), start.tolist()) if d > least[a]}
        got = set()
        for t in by_bucket(passages.Dealer(*passages.WINDOWS, 8, passages.least_document), flushes):
            out = passages.later_windows(t)
            got |= set(zip(out["doc_id"].to_pylist(), out["text_key"].to_pylist(), out["start"].to_pylist()))
        assert got == want
        got, firsts = set(), {}
        for t in by_bucket(passages.Dealer(*passages.WINDOWS, 8, suffixes.least_marked), flushes):
            for r in suffixes.later_and_least(t).to_pylist():
                if r["doc_id"] is None:
                    firsts[r["hash"] % (1 << 64)] = r["first_doc_id"]
                else:
                    got.add((r["doc_id"], r["text_key"], r["start"]))
        assert got == want
        assert firsts == {a: d for a, d in least.items() if any(a == b and e > d for b, e in zip(h.tolist(), doc.tolist()))}


def test_lines_across_flushes():
    import numpy as np

    for seed in range(5):
        (h, low, doc, _, _), flushes = random_windows(seed)
        gone = set()
        for t in by_bucket(lines.dealer(8, 3), [[f[0], f[1], f[2]] for f in flushes]):
            out = lines.confirmed(t, 3)
            gone |= {(d, int(np.frombuffer(k, "<u8")[0])) for d, k in zip(out["drop_id"].to_pylist(), out["key"].to_pylist())}
        holders = {}
        for a, d in zip(h.tolist(), doc.tolist()):
            holders.setdefault(a, set()).add(d)
        assert gone == {(d, a) for a, ds in holders.items() if len(ds) >= 3 for d in ds if d != max(ds)}
