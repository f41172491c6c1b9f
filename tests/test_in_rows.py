"""Sections and overlaps are counted within a row: nothing is shuffled."""

import random
from collections import Counter

from pyspark.sql import functions as F

from caselight.operators import documents, evaluation


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_rouge_counts_within_a_row(spark):
    r = random.Random(5)
    rows = [(k, " ".join(r.choices("ab cd ef gh ij".split(), k=r.randint(0, 12))), " ".join(r.choices("ab cd ef gh".split(), k=r.randint(0, 12)))) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, hypothesis string, reference string")
    for n in (1, 2):
        out = evaluation.rouge_n(df, n)
        assert "Exchange" not in plan_of(out)
        got = {x["id"]: (x["precision"], x["recall"]) for x in out.collect()}
        for k, h, t in rows:
            a, b = (Counter(zip(*(x.split()[i:] for i in range(n)))) for x in (h, t))
            o = sum((a & b).values())
            assert got[k] == (round(o / a.total() + 1e-12, 4) if a else 0.0, round(o / b.total() + 1e-12, 4) if b else 0.0)


def test_versions_of_a_row_are_compared_without_a_shuffle(spark):
    rows = [(1, "x\nSection A\none two\nSection B\nold", "x\nSection B\nold\nSection C\nnew\nSection C\nlast one"), (2, "plain text", "plain text"), (3, "", "some words")]
    df = spark.createDataFrame(rows, "doc_id long, before string, after string")
    out = documents.compare_versions(df)
    assert "Exchange" not in plan_of(out)
    got = {(x["doc_id"], x["section"], x["a"], x["b"], x["change"]) for x in out.collect()}
    assert got == {(1, "Section A", "one two", "", "removed"), (1, "Section C", "", "last one", "added"), (3, "Introduction", "", "some words", "added")}
    two = documents.compare(df.select("doc_id", F.col("before").alias("text")), df.select("doc_id", F.col("after").alias("text")).where("doc_id < 3"))
    assert {(x["doc_id"], x["section"], x["change"]) for x in two.collect()} == {(1, "Section A", "removed"), (1, "Section C", "added")}
