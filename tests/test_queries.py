"""Every query of the engine against its SQL on the smallest tables; those without SQL must run."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = "/root/testdata/sf0.001"

from filigree.plans import registry  # noqa: E402

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        out.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return out


def show(v):
    return "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        r = con.execute(ORACLES[name])
        names = sorted(c[0] for c in r.description)
        at = [[c[0] for c in r.description].index(n) for n in names]
        assert names == sorted(df.columns)
        assert sorted(tuple(show(x[n]) for n in names) for x in rows) == sorted(tuple(show(x[i]) for i in at) for x in r.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
