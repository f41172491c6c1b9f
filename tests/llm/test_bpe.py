import random

import pytest

from caselight.llm import bpe, packing
from tests.llm import brute

PATH = bpe.default_vocabulary()


def long_run(alphabet, size, seed=0):
    r = random.Random(seed)
    return "".join(r.choice(alphabet) for _ in range(size))


ROWS = [
    (1, "The cat sat.\nOn  the\tmat!"),
    (2, None),
    (3, ""),
    (4, " \n　\x85 "),
    (5, "a\x1cb\x1d c<|endoftext|>d <|startoftext|>"),
    (6, "J̌ J̌x ΑΣ ΣΑΣ İi é Å don't DON'T we'll '' 's"),
    (7, "漢字かな 한국어 🙂🙂 a​b ½ x² ٣"),
    (8, "É" * 30 + " ###!! thé%%% it's 4111-1111"),
    (9, long_run("thean", 9000)),
    (10, "start " + long_run("aé漢b!", 7000, 1) + "<|endoftext|>" + long_run("xyz", 5000, 2) + " end."),
    (11, long_run("ab", 20000, 3)),
    (11, long_run("ab", 20000, 3)),
    (None, "no id"),
    (12, "word " * 3000),
]
SCHEMA = "doc_id long, text string, row string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_encode_decode(spark, rows):
    out = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_decode(frame(spark, rows)).collect()]
    tok = bpe.tokenizer(PATH)
    want = []
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(out, key=str) == sorted(want, key=str)


def test_tree_concatenation():
    for alphabet in ("ab", "thean", "é漢b", "!#$'", "𝔘ñ", "ing"):
        for seed in range(5):
            text = long_run(alphabet, random.Random(seed).randint(4096, 9000), seed)
            parts = [(k, r, p, bpe.encode_segment(PATH, k, p)) for k, r, p in bpe.cut(PATH, text)]
            assert bpe.joined(PATH, parts).tolist() == bpe.tokenizer(PATH).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [ROWS, []], ids=["rows", "empty"])
def test_packing(spark, rows):
    parts = packing.pieces(frame(spark, rows), keep_ids=True)
    out = packing.pack(parts).collect()
    tok = bpe.tokenizer(PATH)
    whole = sorted(tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    by_doc, by_sequence = {}, {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    texts = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows}
    for r in out:
        import numpy as np

        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert ids == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] and r["doc_tokens"] == len(texts[r["doc_id"]])
        by_doc[r["doc_id"]] = by_doc.get(r["doc_id"], 0) + r["length"]
    assert sum(by_doc.values()) == sum(map(len, whole))
    built = packing.sequences(packing.pack(parts)).collect()
    assert all(len(r["ids"]) == 4096 or not len(r["ids"]) & (len(r["ids"]) - 1) for r in built)


def test_best_fit_decreasing_is_the_plain_one():
    import numpy as np

    r = random.Random(1)
    lengths = np.array([r.randint(1, 100) for _ in range(700)])
    bins, offsets = packing.best_fit_decreasing(lengths, 100)
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            rooms.append(100 - n)
    assert len(set(bins.tolist())) == len(rooms)
    used = np.bincount(bins, lengths)
    assert sorted(100 - used) == sorted(rooms)


def test_query_packs_with_little_padding(spark):
    """Of the query's own output, with repeated ids, equal lengths and clashing columns."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    clash = docs.unionByName(docs.limit(20)).withColumnsRenamed({"lang": "bucket"}).selectExpr("doc_id", "text", "bucket", "doc_id AS sequence_id", "text AS length")
    out = packing.pack_documents(clash).select("sequence_id", "offset", "length").collect()
    ends = {}
    for s, o, n in sorted(map(tuple, out)):
        assert o == ends.get(s, 0)
        ends[s] = o + n
    total = sum(ends.values())
    assert max(ends.values()) <= packing.WINDOW and len(ends) <= -(-total // packing.WINDOW) * 1.01 + 1
