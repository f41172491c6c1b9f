import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from caselight.llm import bpe, jaccard, quality, simhash
from tests.llm import brute
from tests.llm.test_jaccard import components
from tests.llm.test_pii import plain
from tests.llm.test_topk_quality import brute_quality


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    kept = spark.read.parquet(str(tmp_path / "pii_masking")).select("doc_id").distinct().count()
    assert 0 < kept < before
    assert docs.select("doc_id").distinct().count() == kept
    whole = sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "start", "ids_crc32").collect()))
    assert whole == sorted(map(tuple, docs.select("doc_id", "start", "ids_crc32").collect()))


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def features(text):
    n, chars, symbols, dups, repeats, failed = brute_quality(text)
    lines = sum(1 for x in text.split("\n") if x.strip(brute.SPACE))
    return {
        "n_words": n,
        "symbol_share": symbols / max(chars, 1),
        "mean_word": chars / max(n, 1),
        "dup_line_share": dups / max(lines, 1),
        "repeat_share": repeats / max(n, 1),
        "upper_share": sum("A" <= c <= "Z" for c in text) / max(chars, 1),
        "mark_share": sum(c in quality._MARKS for c in text) / max(chars, 1),
    }, failed


def masked(text):
    out, at = [], 0
    for kind, a, b in sorted(plain(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_rows_are_those_of_plain_stages(spark):
    """Every stage but the rules' learning and the choice of sequences, in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    judged = [(i, t, *features(t)) for i, t in rows]
    rows = [(i, t) for i, t, f, failed in judged if not failed and not any(all(c.holds(f) for c in rule) for rule in rules)]
    rows = brute.without_lines(rows)
    rows = [(i, t) for (i, t), c in zip(rows, components(rows)) if i == c]
    rows = [(i, masked(t)) for i, t in rows]
    want = []
    for i, t in rows:
        ids = bpe.tokenizer(bpe.default_vocabulary()).encode(t, add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            want.append((i, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096


def test_repeated_ids_lose_no_document(spark):
    """A row goes by its own text, not by another's that shares its doc_id."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, b), (5, a), (5, b), (None, b), (None, b), (7, None), (8, ""), (9, a + " end"), (3, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for keep in (jaccard.keep_first, simhash.keep_first):
        got = sorted(((r["doc_id"], r["text"]) for r in keep(docs).collect()), key=str)
        assert got == sorted([(3, b), (3, b), (5, a), (None, b), (None, b), (7, None)] + ([(9, a + " end")] if keep is simhash.keep_first and not near(a, a + " end") else []), key=str)


def near(a, b):
    return bin(brute.fingerprint(a) ^ brute.fingerprint(b)).count("1") <= 4


def test_odd_rows(spark):
    """Nulls in any column, repeated rows and ids, ties, columns with clashing names."""
    sf = "/root/testdata/sf0.001"
    words = " ".join(f"word{k} of the quiet morning" for k in range(30))
    rows = [(1, words), (1, words), (1, words + " and more of it"), (2, words), (None, words), (None, words), (3, None), (4, ""), (5, "short"), (6, words.upper()), (7, "one line here of twenty\n" * 3 + words[::-1]), (8, "mail bob@x.org " + " ".join(f"other{k} thing said" for k in range(30)))]
    docs = spark.createDataFrame([(i, t, None, None, None, "x", "y", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, keys string, gone_id int")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
        found = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=str)
        if name == "quality_rules":
            assert found == [1, 1, 1, 2, 6, 7, 8, None, None]
        if name == "simhash_dedup":  # rows of the least id of a group stay, and those without one
            assert found == [1, 1, 1, 7, 8, None, None]
    assert docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).count() == 4
