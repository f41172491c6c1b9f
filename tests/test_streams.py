"""Linkage as a stream against the batch over all cases; state that ends; sinks that repeat."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from caselight.operators import linkage as batch
from caselight.plans.cases import cases
from caselight.streaming import intake, linkage

SF = "/root/testdata/sf0.001"
FIELDS = batch.FIELDS


def drain(df, name, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination()
    return {r["case_key"]: (r["relation"], r["changed"]) for r in df.sparkSession.table(name).collect()}


def test_linked_stream_is_the_batch_relation(spark, tmp_path):
    # few patients, medicines and reactions, so that most cases have earlier ones
    c = cases(spark, SF).withColumn("patient_token", F.concat(F.lit("p"), (F.col("case_key") % 40).cast("string"))).withColumn("medicine", F.substring("medicine", 1, 6)).withColumn("reaction", F.substring("reaction", 1, 5))
    c = c.withColumn("source_hash", F.concat_ws("|", "patient_token", "medicine", "reaction", "outcome", "seriousness", "route")).select("case_key", "created_at", "patient_token", "medicine", "reaction", "source_hash", *FIELDS).cache()
    c.orderBy("created_at").where("created_at < '1995-01-01'").coalesce(1).write.parquet(str(tmp_path / "in"))
    c.where("created_at >= '1995-01-01'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 2
    stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(linkage.linked(stream, late="40000 days"), "linked_all", tmp_path / "state")
    rows = batch.relations(c).collect()
    assert {k: r for k, (r, _) in got.items()} == {r["case_key"]: r["relation"] for r in rows}
    assert len({r for r, _ in got.values()}) == 3
    alone = {r["case_key"]: r["changed"] for r in rows if r["anchor_seen"]}
    assert {k: got[k][1] for k in alone} == alone


def test_state_ends(spark, tmp_path):
    schema = "case_key long, created_at timestamp, patient_token string, medicine string, reaction string, source_hash string, " + ", ".join(f"{f} string" for f in FIELDS)
    start = datetime(2020, 1, 1)
    for n, (key, patient, days) in enumerate([(1, "a", 0), (2, "a", 1), (3, "b", 40), (4, "b", 41), (5, "a", 42), (6, None, 43), (7, None, 44)]):
        spark.createDataFrame([(key, start + timedelta(days), patient, "m", "r", "h" if key > 5 else "", *("x" for _ in FIELDS))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(linkage.linked(stream, late="1 day", idle=timedelta(10)), "linked_idle", tmp_path / "state")
    # the fifth comes after its anchor's state has ended; the last two have no anchor but a hash
    assert {k: r for k, (r, _) in got.items()} == {1: "new", 2: "duplicate", 3: "new", 4: "duplicate", 5: "new", 6: "new", 7: "duplicate"}


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "event_type", "value")
    events = events.unionByName(events.limit(20))  # equal rows stay
    path, write = str(tmp_path / "out"), intake.once(str(tmp_path / "out"))
    shown = lambda: sorted(map(str, spark.read.parquet(path).select(*events.columns).collect()))
    write(events.where("event_id % 2 = 0"), 0)
    write(events.where("event_id % 2 = 1"), 1)
    whole = sorted(map(str, events.collect()))
    assert shown() == whole
    write(events.where("event_id % 2 = 1"), 1)
    assert shown() == whole
    other, half = str(tmp_path / "half"), intake.once(str(tmp_path / "half"))
    half(events.where("event_id % 4 = 0"), 0)  # what a failure left of the batch
    half(events.where("event_id % 2 = 0"), 0)
    assert sorted(map(str, spark.read.parquet(other).select(*events.columns).collect())) == sorted(map(str, events.where("event_id % 2 = 0").collect()))


def test_sink_of_a_stream(spark, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    for folder in ("a", "b"):  # the second run has lost its progress and sees all again
        q = stream.writeStream.foreachBatch(intake.once(str(tmp_path / "out"), lambda rows: rows.withColumn("written", F.current_timestamp()))).option("checkpointLocation", str(tmp_path / folder)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{SF}/events.parquet").count()
