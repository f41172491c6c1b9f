"""Queries that take the whole table, against plain versions."""

import math
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caselight.functions import text
from caselight.operators import documents, extraction, forms, scoring, severity, summary
from caselight.plans import catalogue
from caselight.plans.cases import cases
from caselight.sources import workbooks

SF = "/root/testdata/sf0.001"


def split(words):
    return [x for s in re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\x01", words).split("\x01") if len(x := s.strip(" \t\n\x0b\f\r")) > 10]


def only(a, b):
    known = {s.lower() for s in b}
    return "|".join([s for s in a if s.lower() not in known][:3])


def test_sentence_changes_take_every_document_both_ways(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    texts = {i: split(x or "") for i, x in zip(t["doc_id"], t["text"])}
    want = sorted((i, only(texts[i + 1], texts[i]), only(texts[i], texts[i + 1])) for i in texts if i + 1 in texts)
    assert any(len(x) >= 5000 for x in t["text"])
    assert sorted(map(tuple, catalogue.QUERIES["sentence_diff"](spark, SF).collect())) == want


def test_sentence_changes_small(spark):
    a = spark.createDataFrame([(1, "Old words stand here. Both have this one."), (2, None), (3, "Only on one side.")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "BOTH have this one. New words stand here. New words stand here."), (2, "Something at last.")], "doc_id long, text string")
    got = sorted(map(tuple, documents.sentence_changes(a, b).collect()))
    assert got == [(1, "New words stand here.|New words stand here.", "Old words stand here."), (2, "Something at last.", "")]


def test_naive_bayes_takes_every_case(spark):
    every = cases(spark, SF)
    assert catalogue.QUERIES["nb_score"](spark, SF).select("case_key").distinct().count() == every.count()
    words = every.select(F.explode(text.tokens(F.col("narrative"))).alias("token")).distinct()
    assert words.join(catalogue.QUERIES["nb_train"](spark, SF), "token", "left_anti").count() == 0


def test_cascade_asks_regression_before_bayes(spark):
    rows = spark.createDataFrame([(k, "Unknown", "", "admitted", "") for k in (1, 2, 3, 4)] + [(5, "Death", "", "", "")], "case_key int, seriousness string, outcome string, narrative string, reaction string")
    model = "case_key int, class string, confidence double"
    lr = spark.createDataFrame([(1, "death", 0.55), (2, "death", 0.5499), (3, "death", 0.3), (5, "others", 0.9)], model)
    nb = spark.createDataFrame([(1, "others", 0.99), (2, "disability", 0.6), (3, "disability", 0.599), (5, "others", 0.9)], model)
    got = sorted(map(tuple, severity.cascade(rows, nb, lr=lr).collect()))
    assert got == [(1, "death", "logistic-regression-ml", 0.55), (2, "disability", "naive-bayes", 0.6), (3, "hospitalisation", "text-pattern", 0.8), (4, "hospitalisation", "text-pattern", 0.8), (5, "death", "seriousness-label-map", 0.95)]


def test_cascade_query_asks_the_models(spark):
    got = catalogue.QUERIES["severity_cascade_models"](spark, SF)
    basis = {r["basis"]: r["count"] for r in got.groupBy("basis").count().collect()}
    assert sum(basis.values()) == cases(spark, SF).count()
    assert basis["logistic-regression-ml"] > 0


def plain_cosines(sentences):
    low = [s.lower() for s in sentences]
    bags = [summary._tokens(s) for s in sentences]
    words = list(dict.fromkeys(w for b in bags for w in b))
    rows = [[bag.count(w) / max(len(bag), 1) * (math.log((len(low) + 1) / (sum(w in s for s in low) + 1)) + 1) for w in words] for bag in bags]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    return [[dot(a, b) / max(math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)), 1e-300) for b in rows] for a in rows]


def test_sentence_cosines_are_the_plain_ones():
    t = pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pydict()["text"]
    for words in sorted(filter(None, t), key=len)[-60::7]:
        sentences = split(words[:4000]) + ["", "é", "the 12th the 12th"]
        graph, want = summary.SentenceGraph(sentences), plain_cosines(sentences)
        assert all(abs(x - y) < 1e-9 for k, row in enumerate(want) for x, y in zip(graph.similar(k), row))
        assert all(abs(x - y) < 1e-9 for x, y in zip(summary._textrank(graph), plain_ranks(want)))
        for keep in (1, 3, 5):
            scores = summary._textrank(graph)
            assert summary._choose(scores, graph, keep) == plain_choice(scores, want, keep)


def plain_ranks(cosines):
    n = len(cosines)
    links = [[0 if i == j else x for j, x in enumerate(row)] for i, row in enumerate(cosines)]
    links = [[x / sum(row) if sum(row) > 0 else 0 for x in row] for row in links]
    scores = [1 / n] * n
    for _ in range(summary.ROUNDS):
        scores = [(1 - summary.DAMPING) / n + summary.DAMPING * sum(scores[i] * links[i][j] for i in range(n)) for j in range(n)]
    return scores


def plain_choice(scores, cosines, k):
    scores = [round(x, 11) for x in scores]
    rank = sorted(range(len(scores)), key=lambda n: -scores[n])
    chosen, rest = rank[:1], rank[1:]
    while len(chosen) < k and rest:
        best = max(rest, key=lambda n: round(summary.MMR * scores[n] - (1 - summary.MMR) * max(cosines[n][c] for c in chosen), 11))
        chosen.append(best)
        rest.remove(best)
    return sorted(chosen)


def test_a_hundred_thousand_sentences_in_bounded_memory():
    import tracemalloc

    r = random.Random(1)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in ("rant", "lost", "mind", "zone", "kept")] + [f"name{k}" for k in range(20_000)]
    sentences = [" ".join(r.choice(words) for _ in range(8)) for _ in range(100_000)]
    tracemalloc.start()
    text, method, _ = summary._summary(". ".join(sentences), sentences, "sae", 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert method == "textrank-mmr" and text.endswith(".") and peak < 400e6  # the pairs alone would take 80 GB


def test_scores_of_short_texts_are_those_of_all_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    from caselight.functions import text

    own = {r["doc_id"]: r["s"] for r in docs.select("doc_id", text.capital_sentences(F.col("text")).alias("s")).collect()}
    got = {}
    for r in summary.sentence_scores(docs).collect():
        got.setdefault(r["doc_id"], {})[r["position"]] = r["score"]
    for i, scores in got.items():
        assert all(abs(scores[k] - x) < 2e-3 for k, x in enumerate(summary._own_scores(own[i], "sae")))


def test_longest_common_subsequences_are_the_plain_ones(spark):
    t = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    words = {i: [w for w in re.sub(r"[^a-z0-9\s]", " ", x.lower()).split() if len(w) > 1] for i, x in zip(t["item_id"], t["text"])}

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for k, y in enumerate(b):
                last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
        return row[-1]

    half = lambda x: math.floor(x * 1e4 + 0.5) / 1e4
    for r in catalogue.QUERIES["rouge_l"](spark, SF).collect():
        a, b = words[r["id"]], words[r["id"] + 1]
        n = lcs(a, b)
        p, c = n / len(a) if a else 0.0, n / len(b) if b else 0.0
        assert (r["precision"], r["recall"], r["f1"]) == (half(p), half(c), half(2 * p * c / (p + c) if p + c else 0.0))


def test_wrapped_lines_are_the_plain_ones(spark):
    t = dict(zip(*pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values()))
    for r in catalogue.QUERIES["wrapped_text"](spark, SF).collect():
        lines = []
        for w in t[r["item_id"]].split():
            if lines and len(lines[-1]) + 1 + len(w) <= 105:
                lines[-1] += f" {w}"
            else:
                lines.append(w)
        assert r["wrapped"] == "\n".join(lines)


def test_inspection_classes():
    """Each critical pattern has its word."""
    hits = ["Contaminated room", "sterility breach", "Pathogens", "adulterated lot", "immediate danger", "Microbiology failure seen in the water loop", "data manipulation", "unauthorised batch", "cross contamination", "recall required"]
    assert len(documents.CRITICAL) == len(hits)
    assert all(re.search(p, x, re.IGNORECASE) for p, x in zip(documents.CRITICAL, hits))


def test_families_of_severity_models(spark):
    rows = spark.createDataFrame([(k, "death" if k % 2 else "others", "fatal died gone" if k % 2 else "mild itch rash") for k in range(60)], "id long, class string, note string")
    for family in severity.FAMILIES:
        model, scores = severity.train_models(rows, "id", "class", "note", k=2, family=family)
        assert min(scores) == 1.0
        if family == severity.FAMILIES[0]:
            idf, cells, start = severity.exported(model, spark)
            assert idf.count() and {r["class"] for r in cells.collect()} == {r["class"] for r in start.collect()} == {"death", "others"}


def test_many_classes_are_all_learned(spark):
    rows = spark.createDataFrame([(f"c{k}", f"word{k} shared") for k in range(1500)], "class string, note string")
    assert severity.nb_train(rows, "class", "note").select("class").distinct().count() == 1500


def test_guidelines_take_every_rule_or_none(spark):
    rows = spark.createDataFrame([(1.0, 100, "", "x")], "confidence double, score int, a string, b string")
    rules = lambda n: spark.createDataFrame([("a" if k % 2 else "b", 1, True) for k in range(n)], "field string, weight int, mandatory boolean")
    assert scoring.guideline_scores(rows, rules(40)).first()["preview"] == 80
    with pytest.raises(ValueError):
        scoring.guideline_scores(rows, rules(scoring.MOST_RULES + 1))


def test_workbooks_round_trip(spark, tmp_path):
    first = spark.createDataFrame([("a & b <c>", 1, None), ("é | x", 2, 0.5)], "name string, n int, share double")
    second = spark.createDataFrame([(True, "line\nbreak")], "ok boolean, text string")
    (tmp_path / "one.xlsx").write_bytes(workbooks.workbook({"First": first, "Second sheet": second, "Empty": first.limit(0)}))
    (tmp_path / "none.xlsx").write_bytes(b"no workbook")
    got = sorted((r["sheet_name"], r["row_number"], r["text"], r["row"]["sheetName"], r["row"].get("name")) for r in workbooks.read_path(spark, str(tmp_path / "*.xlsx")).collect())
    assert got == [("First", 1, "a & b <c> 1 ", "First", "a & b <c>"), ("First", 2, "é | x 2 0.5", "First", "é | x"), ("Second sheet", 1, "True line\nbreak", "Second sheet", None)]
    assert workbooks.markdown({"First": first}, "Report") == "# Report\n\n## First\n\n| name | n | share |\n|-|-|-|\n| a & b <c> | 1 |  |\n| é \\| x | 2 | 0.5 |\n"


def test_workbooks_with_shared_strings_and_gaps():
    import io
    import zipfile

    ns = workbooks.MAIN
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{workbooks.RELATED}"><sheets><sheet name="S" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{workbooks.PACKAGE}/relationships"><Relationship Id="rId7" Type="x" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>one</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="AB2"><v>4.5</v></c></row><row/></sheetData></worksheet>')
    ((name, rows),) = workbooks.sheets(out.getvalue())
    assert name == "S" and list(rows) == [["one", "", "two runs"], [""] * 27 + ["4.5"], []]


def test_pair_model(spark):
    cases_ = spark.createDataFrame([(k, "F" if k % 2 else "M", f"d{k // 2}", "r", "x", "o", "h" if k % 4 < 2 else "", str(30 + k)) for k in range(80)], "case_key int, gender string, medicine string, reaction string, outcome string, seriousness string, source_hash string, age string")
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 79)], "base int, other int")
    features = forms.pair_features(pairs, cases_, F.col("reaction"))
    one = features.where("base = 0").first()
    assert [one[f] for f in forms.PAIR_FEATURES] == [0, 1, 1, 1, 1, 1, 0.05, 1]
    model, metrics = forms.pair_model(features.withColumn("t", F.col("same_drug") == 1), "t")
    assert metrics.first()["f1"] == 1.0 and model.coefficients.size == len(forms.PAIR_FEATURES)
    assert forms.pair_model(features.limit(5).withColumn("t", F.lit(True)), "t") == (None, None)


def plain_fields(words):
    """Extraction with Python's own regular expressions, every pattern tried on every text."""
    strip = lambda x: x.strip(" \t\n\x0b\f\r")
    clean = lambda x: strip(re.sub(r"[:|]+\Z", "", re.sub(r"[ \t\n\x0b\f\r]+", " ", x or "")))
    find = lambda p, x: clean(m[1]) if (m := re.search(p, x, re.ASCII)) else ""
    marked = bool(re.search(extraction.MARKER, words))
    source = re.split(extraction.MARKER, words)[-1] if marked else words
    places = list(re.finditer(rf"(?i){'(?<![^\n])' if marked else r'(?<!\S)'}({'|'.join(extraction.LABELS)}):", source, re.ASCII))
    given = {}
    for m, after in zip(places, [*places[1:], None]):
        given.setdefault(m[1].lower(), clean(source[m.end() : after.start() if after else len(source)]))
    low, out = words.lower(), {}
    term = lambda terms: next((name for t, name in terms if t in low), "")
    for name, labels in extraction.FIELD_LABELS.items():
        tried = [given.get(label.lower(), "") for label in labels] + [find(p, words) for _, p in extraction.ANYWHERE.get(name, ())]
        if not marked:
            tried += [find(p, words) for _, p in extraction.FREE.get(name, ())]
            if name in extraction.TITLED:
                value = find(extraction.TITLED[name][1], words)
                tried.append("" if re.search(extraction.LAYOUT_WORDS, value.lower()) else value)
            if name == "outcome":
                tried += [find(extraction.OUTCOME_TICKED, find(extraction.OUTCOME_BLOCK[1], words)), term(extraction.OUTCOMES)]
            if name == "seriousness":
                tried.append(term(extraction.SERIOUSNESS))
        out[name] = next((x for x in tried if x), "")
    return out


def test_extraction_is_the_plain_one(spark):
    from .test_typed_in import _CASES

    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = [(i, x) for i, x in zip(t["doc_id"], t["text"])]
    r = random.Random(4)
    bits = [line for _, x in _CASES for line in (x or "").split("\n")] + ["15. Outcome: X Recovering", "i Warfarin 5 mg oral daily N/A", "i Metformin N/A N/A N/A 3", "Dose: route", "Outcome: Region: north", "onset: 01/02/2024", "patient name", "description of reaction: a long rash", "Institution: City Hospital", "30 yrs"]
    rows += [(10_000 + k, r.choice(["\n", " ", "\n\n"]).join(r.choice(bits) for _ in range(r.randint(1, 12)))) for k in range(300)]
    rows += [(20_000, None), (20_001, "")]
    got = {x["doc_id"]: x for x in extraction.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in rows:
        want = plain_fields(x or "")
        assert {n: got[i][n] for n in want} == want, x


def test_risk_flags_are_the_last_word_on_seriousness(spark):
    rows = spark.createDataFrame([(1, "nothing of note", "serious, late"), (2, "life-threatening", "serious"), (3, "nothing", None)], "doc_id int, text string, row_risk_flags string")
    got = {r["doc_id"]: r["seriousness"] for r in extraction.extract(rows).collect()}
    assert got == {1: "Other medically important", 2: "Life-threatening", 3: ""}


def test_reports_count_every_observation(spark, tmp_path):
    """F1 (round 4)"""
    numbered = "\n".join(f"{k}. Paint came off the wall" for k in range(1, 61)) + "\n61. Pest activity near the door\n62. Adulterated syrup in the store"
    plain = "\n".join(f"The visit of hall {k:02d} went on quietly there" for k in range(70))
    rows = [(1, numbered), (2, plain), (3, "\n".join(numbered.split("\n")[:50])), (4, "\n".join(numbered.split("\n")[:51])), (5, None), (6, "short")]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([x for _, x in rows], pa.string())}), tmp_path / "documents.parquet")
    got = {n: sorted(map(tuple, catalogue.QUERIES[n](spark, str(tmp_path)).collect())) for n in ("inspection_reports", "inspection_documents", "inspection_sections")}
    fine = "Acceptable with Minor Observations"
    assert got["inspection_reports"] == [(1, 62, 1, 1, 60, "Reject / Immediate Action Required"), (2, 70, 0, 0, 70, fine), (3, 50, 0, 0, 50, fine), (4, 51, 0, 0, 51, fine)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    for name, rows in got.items():  # the other two are cut as their SQL says
        assert rows == sorted(con.execute(catalogue.SQL[name]).fetchall()), name
