"""The manifest against a plain tree over lists."""

import zlib

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caselight.llm import merkle, queries

from .brute import lower, sha

SCHEMA = StructType([StructField(n, t()) for n, t in (("doc_id", LongType), ("text", StringType), ("lang", StringType), ("source", StringType), ("n_chars", LongType))])


def encoded(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(i, text, lang, source, n):
    return sha("".join(map(encoded, (i, source, lang, n, text))))


def built(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha("".join(x[k : k + 8])) for k in range(0, len(x), 8)])
    return levels


def siblings(levels, at):
    for x in levels[:-1]:
        a = at // 8 * 8
        yield x[a:at], x[at + 1 : a + 8]
        at //= 8


def plain(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted(trees[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for x in names}
    lower_levels = {x: built([leaf(*r) for r in order[x]]) for x in names}
    upper = built([lower_levels[x][-1][0] for x in names])
    for number, x in enumerate(names):
        for at, r in enumerate(order[x]):
            proof = [*siblings(lower_levels[x], at), *siblings(upper, number)]
            i, text, lang, source, n = r
            f = leaf(i, lower(text) if text is not None else None, lang, source, n) if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else leaf(*r)
            for a, b in proof:
                f = sha("".join(a) + f + "".join(b))
            yield i, leaf(*r), lower_levels[x][-1][0], upper[-1][0], sha("".join("".join(a) + "".join(b) for a, b in proof)), f, f == upper[-1][0]


def result(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("pos", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(str, (tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect())))


def test_odd_rows(spark, tmp_path):
    rows = [(i, f"Text {i} " + "é" * (i % 3), "en" if i % 3 else ("é" if i % 2 else None), "s", i) for i in range(300)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (7, None, "en", None, 1), (7, "", "en", "", 1), (7, "", "en", "", 1), (-5, "x" * 100_000, "", "s", 5), (9, "LOW", "one", "s", None)]
    rows += [(3, "Copy", "en", "s", 4)] * 70
    assert result(spark, tmp_path, rows) == sorted(map(str, plain(rows)))


def test_large_groups_of_copies_are_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "CHUNK", 16)
    monkeypatch.setattr(merkle, "ROWS", 50)
    rows = [(3, "Copy", "en", "s", 4)] * 100 + [(i, "Text", "en", "s", 4) for i in range(90)]
    assert result(spark, tmp_path, rows) == sorted(map(str, plain(rows)))


def test_one_row_and_no_row(spark, tmp_path):
    one = [(3, "One", "en", "s", 4)]
    assert result(spark, tmp_path / "one", one) == sorted(map(str, plain(one)))
    assert result(spark, tmp_path / "none", []) == []


def test_a_proof_holds_for_its_leaf_alone(spark):
    docs = spark.createDataFrame([(i, f"Text {i}", "en", "s", i) for i in range(100)], SCHEMA)
    rows = merkle.manifest(docs).withColumn("own", merkle.folded(F.col("leaf"), F.col("proof"))).withColumn("other", merkle.folded(F.sha2(F.lit("other"), 256), F.col("proof"))).collect()
    assert all(r["own"] == r["root"] != r["other"] for r in rows)
    assert sorted(r["pos"] for r in rows) == list(range(100))
