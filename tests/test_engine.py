"""Properties, readers, writers and streams."""

import json

import pytest
from pyspark.sql import functions as F

from caselight.functions import text
from caselight.operators import evaluation, linkage, privacy, severity, signals, summary
from caselight.plans.cases import cases
from caselight.sources import readers, writers
from caselight.streaming import intake

SF = "/root/testdata/sf0.001"


def test_entry_is_the_flagship(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "prr" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_contingency_adds_up(spark):
    c = cases(spark, SF)
    n = c.count()
    assert signals.contingency(c).where(F.col("a") + F.col("b") + F.col("c") + F.col("d") != n).count() == 0


def test_privacy_bounds(spark):
    c = cases(spark, SF)
    kept = privacy.released_classes(c).agg(F.min("size"), F.min("outcome_values")).first()
    assert kept[0] >= privacy.K and kept[1] >= privacy.L
    assert all(0 <= r["t"] <= 1 for r in privacy.t_closeness(c).collect())
    assert privacy.record(c.limit(10)).first()["insufficient"]


def test_linkage_chain(spark):
    rows = [(1, "2025-01-01", "p", "m", "r", "Recovering", "h1"), (2, "2025-01-02", "p", "m", "r", "Recovering", "h2"), (3, "2025-01-03", "P", "m", "r", "x", "h3"), (4, "2025-01-04", "p", "M ", "r", "Fatal", "h4"), (5, "2025-01-05", "p", "", "r", "Fatal", "h5"), (6, "2025-01-06", "q", "z", "z", "z", "h1")]
    df = spark.createDataFrame(rows, "case_key long, created_at string, patient_token string, medicine string, reaction string, outcome string, source_hash string")
    got = {r["case_key"]: (r["relation"], r["changed"]) for r in linkage.relations(df, ("outcome",)).collect()}
    assert got == {1: ("new", ""), 2: ("duplicate", ""), 3: ("new", ""), 4: ("followup", "outcome"), 5: ("new", ""), 6: ("duplicate", "")}


def test_mcc_of_a_perfect_and_a_constant_guess(spark):
    rows = spark.createDataFrame([("death", "death"), ("others", "others")] * 5, "t string, g string")
    assert evaluation.mcc(evaluation.confusion(rows, "t", "g"), "t", "g").first()["mcc"] == 1.0
    same = rows.withColumn("g", F.lit("death"))
    assert evaluation.mcc(evaluation.confusion(same, "t", "g"), "t", "g").first()["mcc"] == 0.0


def test_rouge_l(spark):
    rows = spark.createDataFrame([(1, "a1 b2 c3 d4 e5", "a1 x9 c3 e5"), (2, "", "a1")], "id long, hypothesis string, reference string")
    out = {r["id"]: (r["precision"], r["recall"]) for r in evaluation.rouge_l(rows).collect()}
    assert out == {1: (0.6, 0.75), 2: (0.0, 0.0)}


def test_rounding(spark):
    got = spark.createDataFrame([(1.005,), (0.285,), (-1.235,), (2.5,)], "x double").select(text.rounded(F.col("x"), 2)).collect()
    assert [r[0] for r in got] == [1.0, 0.28, -1.24, 2.5]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\r\ntwo  \t three")
    (tmp_path / "b.json").write_text(json.dumps([{"k": 1}, {"k": "x"}]))
    (tmp_path / "c.csv").write_text("medicine,outcome\nWarfarin,\nAspirin,Fatal\n")
    (tmp_path / "d.html").write_text("<p>Hello<b>you</b></p><script>x</script>")
    (tmp_path / "e.pdf").write_bytes(b"%PDF-1.4 rest")
    assert readers.read_text(spark, str(tmp_path / "a.txt")).first()["text"] == "one\n\ntwo three"
    j = readers.read_json(spark, str(tmp_path / "b.json")).first()
    assert j["root_type"] == "array" and [r["k"] for r in j["rows"]] == ["1", "x"]
    sheet = readers.read_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [r["row"]["outcome"] for r in sheet] == ["", "Fatal"] and sheet[0]["row"]["sheetName"] == "c"
    assert readers.read_markup(spark, str(tmp_path / "d.html")).first()["text"] == "Hello you x"
    found = readers.files(spark, str(tmp_path), ("e.pdf", "a.txt"))
    assert {(r["name"], r["kind"], r["magic"]) for r in found.collect()} == {("e.pdf", "pdf", "PDF"), ("a.txt", "text", "unknown")}
    pdf = readers.read_with(found.where("kind = 'pdf'"), lambda b: b.decode("latin1"))
    assert pdf.first()["needs_ocr"]
    both = readers.union_sheets([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert both.columns == ["a", "b"] and both.count() == 2


def test_writers(spark, tmp_path):
    rows = cases(spark, SF).select("case_key", "created_at")
    writers.append_reports(rows, str(tmp_path / "r"))
    writers.append_reports(rows, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2 * rows.count()
    events = spark.createDataFrame([("login",)], "action string")
    assert writers.append_audit(events, str(tmp_path / "audit"))
    (tmp_path / "file").write_text("x")
    assert not writers.append_audit(events, str(tmp_path / "file" / "below"))
    writers.write_metrics(events, str(tmp_path / "m"))
    writers.write_metrics(events, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "m")).count() == 1
    made = writers.synthetic_cases(spark, 2000)
    shares = {r["kind"]: r["count"] for r in made.groupBy("kind").count().collect()}
    assert 120 <= shares["duplicate"] <= 240 and 180 <= shares["followup"] <= 300
    assert sorted(map(str, made.collect())) == sorted(map(str, writers.synthetic_cases(spark, 2000).repartition(3).collect()))


def test_summaries(spark):
    rows = [(1, "Short."), (2, " ".join(f"The patient number {k} had an adverse drug reaction of kind {k * 7}." for k in range(9))), (3, "First sentence of a decent size here. Second one is also long enough to count. Third sentence follows the others. Fourth ends the whole little text."), (4, None)]
    out = {r["doc_id"]: r for r in summary.summarise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["method"] == "passthrough" and out[2]["method"] == "textrank-mmr" and out[3]["method"] == "tfidf-mmr" and out[4]["summary"] == ""
    assert all(s.rstrip(".") in rows[1][1] for s in out[2]["summary"].split(". "))


def test_trained_models(spark):
    rows = spark.createDataFrame([(k, "death" if k % 2 else "others", "fatal died gone" if k % 2 else "mild itch rash") for k in range(60)], "id long, class string, note string")
    model, scores = severity.train_models(rows, "id", "class", "note")
    assert min(scores) == 1.0
    counts = severity.folds(rows, "id", "class").groupBy("class", "fold").count().collect()
    assert {r["count"] for r in counts} == {6}


@pytest.fixture
def event_stream(spark):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)


def drain(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_windowed_stream_is_the_batch_query(spark, event_stream):
    from caselight.plans import catalogue

    drain(intake.windowed_counts(event_stream), "windows", "complete")
    got = sorted((r["start"], r["event_type"], r["n"]) for r in spark.table("windows").collect())
    want = sorted((r["start"], r["event_type"], r["n"]) for r in catalogue.QUERIES["event_windows"](spark, SF).collect())
    assert got == want
