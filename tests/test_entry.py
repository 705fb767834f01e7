import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
BASE = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def norm(v):
    return f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(BASE))
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    got = sorted([norm(r[c]) for c in columns] for r in df.collect())
    rel = con.sql(BASE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted([norm(r[i]) for i in at] for r in rel.fetchall())
    assert got or name == "filter_min_counts"  # too few rows at this size


def test_entry(spark):
    assert entry.entry(spark).count() > 0
