"""Steps whose cost once grew faster than their input."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from caselight.functions import text
from caselight.operators import documents as docs_ops
from caselight.operators import identifiers, severity, summary
from caselight.plans import catalogue


def test_grams_of_a_long_text_are_made_of_one_list_of_words(spark):
    long = " ".join(f"word{k} again" for k in range(8000))
    rows = spark.createDataFrame([(1, long), (2, "one"), (3, None), (4, "a bb cc")], "id int, note string").repartition(1)
    began = time.time()
    found = {r["id"]: r["g"] for r in rows.select("id", text.ngrams(text.tokens(F.col("note"), 1), 2).alias("g")).collect()}
    assert time.time() - began < 20  # made anew for each of them, the 16,000 words took minutes
    assert len(found[1]) == 15999 and found[1][:2] == ["word0 again", "again word1"] and found[2] == found[3] == [] and found[4] == ["bb cc"]


def _plans(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_naive_bayes_shuffles_no_tokens(spark):
    rows = spark.createDataFrame([(k, f"fever rash note{k % 7}" if k % 2 else "sleep sleep well", "a" if k % 2 else "b") for k in range(60)], "id int, note string, class string")
    model = severity.nb_train(rows, "class", "note")
    out = severity.nb_score(rows, model, "id", "note")
    plan = _plans(out)
    assert "hashpartitioning(id" in plan and "hashpartitioning(token" not in plan.split("BroadcastExchange")[0] and "Window" not in plan
    assert {r["class"] for r in out.where("id % 2 = 1").collect()} == {"a"} and {r["class"] for r in out.where("id % 2 = 0").collect()} == {"b"}
    # tokens that a model has for some classes only, and rows without any token of it
    part = spark.createDataFrame([("a", "fever", -1.0), ("b", "sleep", -2.0), ("c", "sleep", -2.0)], "class string, token string, log_prob double")
    few = spark.createDataFrame([(1, "fever fever"), (2, "sleep"), (3, "nothing"), (4, None)], "id int, note string")
    assert {(r["id"], r["class"], r["confidence"]) for r in severity.nb_score(few, part, "id", "note").collect()} == {(1, "a", 1.0), (2, "c", 0.5)}


def test_new_sentences_of_long_texts(spark):
    """F16"""
    a = " ".join(f"This is the sentence {k}." for k in range(20000))
    b = " ".join(f"This is the SENTENCE {k}." for k in range(2, 20000)) + " Only the other has this. Only the Other has this."
    began = time.time()
    first, second = spark.createDataFrame([(1, a)], "doc_id int, text string"), spark.createDataFrame([(1, b)], "doc_id int, text string")
    r = docs_ops.sentence_changes(first, second).first()
    assert time.time() - began < 40  # each sentence compared all others of both texts
    assert r["added"] == "Only the other has this.|Only the Other has this." and r["removed"] == "This is the sentence 0.|This is the sentence 1."


def test_sentences_are_scored_within_their_row(spark):
    """F9, F19"""
    docs = spark.createDataFrame([(1, "The patient had a rash. The drug was stopped then. It was a rather dull day. Nothing else was seen by them."), (2, ""), (3, None)], "doc_id int, text string")
    assert "Exchange" not in _plans(summary.sentence_scores(docs)) and "Exchange" not in _plans(summary.leading_by_score(docs))
    assert [(r["doc_id"], r["position"]) for r in summary.sentence_scores(docs).collect()] == [(1, k) for k in range(4)]
    best = {r["doc_id"]: r["summary"] for r in summary.leading_by_score(docs, most=1).collect()}
    assert best == {1: "The patient had a rash..", 2: "", 3: ""}


def test_observations_are_chosen_within_their_row(spark):
    """F21, F25"""
    text_of = "1. Batch record missing here\nno sign of a number, but a long line\n  2. Contaminated batch seen \n- short"
    docs = spark.createDataFrame([(1, text_of), (2, "A line that is longer than thirty characters\nA short line it is"), (3, None)], "doc_id int, text string")
    seen = docs_ops.observations(docs)
    assert "Exchange" not in _plans(seen)
    assert [tuple(r) for r in seen.collect()] == [(1, 0, "1. Batch record missing here"), (1, 2, "2. Contaminated batch seen"), (2, 0, "A line that is longer than thirty characters")]
    assert [r["position"] for r in docs_ops.observations(docs, most=1).where("doc_id = 1").collect()] == [0]
    grid = docs_ops.inspection_template(docs, docs_ops.deficiencies(seen))
    assert "hashpartitioning(doc_id" in _plans(grid) and ", section" not in "".join(x.split(")")[0] for x in _plans(grid).split("hashpartitioning(")[1:])
    rows = {(r["doc_id"], r["section"]): (r["n"], r["status"]) for r in grid.collect()}
    assert len(rows) == 24 and rows[1, "deficiencies"] == (2, "observations-found") and rows[1, "manufacturing"] == (2, "observations-found") and rows[2, "site_info"] == (0, "no-observations") and rows[3, "deficiencies"] == (0, "pending")


def test_texts_are_looked_through_once(spark):
    """F23"""
    docs = spark.createDataFrame([(1, "mail a.b@c.org and d@e.org"), (2, "nothing"), (3, None), (4, "@ alone")], "doc_id int, text string")
    found = identifiers.findings(docs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in x and "regexp_count" in x for x in plan.split("\n"))
    assert [(r["doc_id"], r["position"], r["entity"]) for r in found.collect()] == [(1, 0, "Email address (2 occurrence(s))")]


@pytest.mark.parametrize("name", ["link_states", "link_incremental", "link_versions", "overview"])
def test_cases_are_made_once(spark, name):
    """F18, F20, F22, F24"""
    out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert "lineitem" not in _plans(out) and "held-" not in _plans(out)
    assert out.count() == (1 if name == "overview" else catalogue.QUERIES["case_table"](spark, "/root/testdata/sf0.001").count())


def test_white_space_at_both_ends(spark):
    every = "".join(text.WHITE)
    rows = spark.createDataFrame([(every + "a" + every + "b" + every,), (every,), ("",), (None,), (" x ",)], "s string")
    assert [r[0] for r in rows.select(text.trimmed(F.col("s"))).collect()] == ["a" + every + "b", "", "", None, " x "]
