import os

import pytest

import __spark_entry__ as entry
from packloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(rows):
    def one(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v

    return sorted(repr([one(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    assert got
    if name in registry.ORACLE:
        cur = duck.execute(registry.ORACLE[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert plain([r[i] for i in at] for r in cur.fetchall()) == got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
