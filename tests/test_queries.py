"""Every registered query against its SQL on the small tables."""

import datetime as dt
import math

import duckdb
import pytest

from barloom.operators import factors, research
from barloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return made


def normal(rows):
    def one(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.5g}") + 0.0
        return x

    return sorted((tuple(map(one, r)) for r in rows), key=str)


def same(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-3, abs_tol=2e-5)) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    quoted = ", ".join('"' + n + '"' for n in names)
    want = con.execute(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall()
    mine = normal(map(tuple, got.select(*names).collect()))
    theirs = normal(want)
    assert len(mine) == len(theirs)
    assert all(same(a, b) for a, b in zip(mine, theirs))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_built_in_factors_are_all_there(spark):
    got = {r.factor for r in QUERIES["factors_builtin"](spark, SF).select("factor").distinct().collect()}
    assert got == {f.name for f in (*factors.RAW, *factors.ROLLING)}


def test_the_reversion_rule_fires_with_its_own_limits(spark):
    """Planted: a fall far below the vwap with shrinking sells, then a return to it."""
    day = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(120)]
    rows = []
    for k in range(120):
        dev = -0.05 if 100 <= k < 110 else 0.0002 if k == 110 else 0.001 * (1 if k % 2 else -1)
        rows.append((day[k], "A", dev, 0.01 * (1 if k % 2 else -1), 1.0 - 0.001 * k, 50.0 + k % 3, 90.0 - k if 95 <= k <= 105 else 50.0 + k % 3))
    p = spark.createDataFrame(rows, "ts timestamp, symbol string, vwap_deviation double, ofi double, realized_vol double, buy_volume double, sell_volume double")
    got = {r.ts: (r.signal, r.position) for r in research.reversion_position(p).collect()}
    assert got[day[102]] == (1, 1) and got[day[99]] == (0, 0)
    assert [got[day[k]][1] for k in (108, 109, 110, 111)] == [1, 1, 0, 0]
