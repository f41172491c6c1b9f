"""Licence notices against every block with every template."""

import math
import random
import re

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from caselight.llm import licenses, queries

from .brute import lower

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("words", StringType()), StructField("label", StringType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(doc_id, text):
    words = WORD.findall(lower(text or ""))
    places = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    found, score = set(), 1.0 if places else 0.0
    by_run = {}
    for label, notice in licenses.TEMPLATES:
        own = WORD.findall(lower(notice))
        by_run.setdefault(max(8, 2 ** math.ceil(math.log2(len(own)))), []).append((label, frozenset(own)))
    for run, templates in by_run.items():
        for start in range(0, len(words), run):
            block = set(words[start : start + 2 * run])
            held = [(label, t, t & block) for label, t in templates if len(t & block) >= licenses.THRESHOLD * len(t) - 1e-9]
            for label, t, shared in held:
                if not any(shared < other or (shared == other and len(u) < len(t)) for _, u, other in held):
                    found.add(label)
                    score = max(score, len(shared) / len(t))
    base = {label for _, label in places}
    return doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | found)), round(score, 9)


def scanned(spark, folder, rows):
    spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    out = queries.op12_licenses(spark, str(folder))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted(map(str, ((*r[:-1], round(r[-1], 9)) for r in out.collect())))


def damaged(r, text):
    words = text.split()
    for _ in range(r.randrange(4)):
        at = r.randrange(len(words))
        words[at : at + 1] = r.choice(([], ["word"], [words[at], words[at]]))
    return " ".join(words)


def test_planted_notices(spark, tmp_path):
    r = random.Random(2)
    filler = "the of and work is licensed under version software permission this with any 4 0 alpha beta gamma delta cc by license public".split()
    rows = []
    for i in range(400):
        prose = [" ".join(r.choice(filler) for _ in range(r.randrange(0, 60))) for _ in range(3)]
        notice = damaged(r, r.choice(licenses.TEMPLATES)[1]) if i % 3 else ""
        rows.append((i, f"{prose[0]}.\n{notice}\n{prose[1]}; {r.choice(licenses.TEMPLATES)[1].upper() if i % 5 == 0 else ''} {prose[2]}"))
    assert scanned(spark, tmp_path, rows) == sorted(map(str, (plain(*x) for x in rows)))


def test_odd_rows(spark, tmp_path):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    long = "word " * 50_000 + gpl + " word" * 50_000 + " Licensed under CC BY-NC 4.0"
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t-"), (4, long), (5, gpl), (5, gpl), (5, "other"), (None, gpl), (6, "cc by"), (7, "CC-BY and cc by CC by"), (8, "Kcc by İ"), (9, "All Rights Reserved"), (10, "\x00all\x01rights\x7freserved")]
    rows += [(20, gpl)] * 50
    assert scanned(spark, tmp_path, rows) == sorted(map(str, (plain(*x) for x in rows)))


def test_no_rows(spark, tmp_path):
    assert scanned(spark, tmp_path, []) == []


@pytest.mark.parametrize("text, labels", [("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc-4.0"), ("Licensed under CC BY 4.0", "cc-by,cc-by-4.0"), ("This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"), ("A work of the public, in general under license of the state", "")])
def test_the_larger_match_stands(text, labels):
    assert plain(1, text)[6] == labels


def test_too_many_words_are_refused(spark):
    docs = spark.createDataFrame([(1, "a", "", "")], SCHEMA)
    with pytest.raises(ValueError):
        licenses.scan(docs, (("many", " ".join(f"w{k}" for k in range(licenses.MOST_WORDS + 1))),))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "", "")], SCHEMA)
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
