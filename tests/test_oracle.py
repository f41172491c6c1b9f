"""Each query with SQL against DuckDB, on the smallest tables; the others must give rows."""

import math

import duckdb
import pytest

from caselight.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    con.execute(catalogue.SQL[name])
    names = [x[0] for x in con.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert got == want


def test_partitioning_does_not_matter(spark):
    rows = {}
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        for name in ("link_relation", "link_history", "signal_prr", "privacy_tclose", "medicine_rollup", "nb_score"):
            rows.setdefault(name, []).append(sorted(map(str, catalogue.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(a == b for a, b in rows.values())
