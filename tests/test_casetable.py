"""Clustered reports: pages against sorting everything, and which files are read."""

import datetime
import random

from caselight.sources import casetable


def test_pages(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, datetime.date(2023, 1, 1) + datetime.timedelta(r.randrange(300)), f"s{k % 3}") for k in range(400)] + [(k, None, "undated") for k in range(900, 905)]
    path = str(tmp_path / "t")
    df = spark.createDataFrame(rows, "case_key long, created_at date, status string")
    casetable.write(df.where("case_key < 200 OR case_key >= 900"), path, files=6)
    casetable.write(df.where("case_key >= 200 AND case_key < 900"), path, files=6)
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or datetime.date.min, x[0]), reverse=True)
    assert casetable.months(spark, path)[0] == "2023-10" and casetable.months(spark, path)[-1] == casetable.UNDATED
    after, got, read = None, [], []
    while len(got) < 400:
        page, seen = casetable.page(spark, path, 25, after)
        part = [tuple(x) for x in page.select("case_key", "created_at", "status").collect()]
        assert len(seen) <= 3 and all(f"month={m}" in "".join(page.inputFiles()) for m in seen)
        assert {f.split("month=")[1][:7] for f in page.inputFiles()} == set(seen)
        got, read = got + part, read + seen
        after = (part[-1][1], part[-1][0])
    assert got == want[: len(got)]
    last, _ = casetable.page(spark, path, 500, None)
    assert [tuple(x) for x in last.select("case_key", "created_at", "status").collect()][:400] == want[:400] and last.count() == 405


def test_scans_by_time(spark, tmp_path):
    path = str(tmp_path / "t")
    casetable.write(spark.createDataFrame([(k, datetime.date(2024, 1 + k % 6, 2)) for k in range(60)], "case_key long, created_at date"), path)
    some = casetable.scan(spark, path, "2024-02", "2024-03")
    assert {r["case_key"] % 6 for r in some.collect()} == {1, 2} and some.count() == 20
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "month" in plan.split("PartitionFilters")[1][:200]
    assert casetable.page(spark, path, 0)[0].count() == 0
