"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import canon

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CORE = {n: s for m in entry.catalog.MODULES for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{i}" for i in (1, 2, 3, 5)} <= {n.split("_")[0] for n in entry.queries()}
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 10


@pytest.mark.parametrize("name", sorted(CORE))
def test_sql_twin(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(CORE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
