import duckdb
import pytest

import __spark_entry__ as entry
from lodestrata.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def value(v):
    if isinstance(v, float):
        return round(v, 6)
    return [value(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in registry.SQL:
        assert got
        return
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_split_has_no_leak(spark):
    df = registry.QUERIES["q_manifest_documents"](spark, SF).where("status = 'usable'")
    assert df.groupBy("specimen").count().where("count > 1").count() == 0
