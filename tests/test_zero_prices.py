"""Queries against their SQL on events some of which have a price of 0: quotients over it
are infinite or NaN there, and stay so in what is made of them."""

import math

import duckdb
import pytest

from barloom.plans.registry import ORACLE_SQL, QUERIES

NAMES = """
regimes_and_merged_signals
reversion_signal
vwap_features
factor_change_diff
factors_builtin
forward_returns
feature_set
amplitude_momentum
composite_factor
buffer_zone
funding_cost
fixed_bins
factor_loss
factor_summary
ls_performance
ls_nav
quantile_bins
ic_by_date
ic_summary
factor_crowding
factor_capacity
grid_scan
""".split()


@pytest.fixture(scope="module")
def made(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("zero-prices"))
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 37 = 5 THEN 0 ELSE value END AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return folder, con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-5)
    return a == b


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql_at_prices_of_zero(spark, made, name):
    folder, con = made
    got = QUERIES[name](spark, folder)
    names = sorted(got.columns)
    quoted = ", ".join('"' + n + '"' for n in names)
    order = lambda r: (str([x for x in r if not isinstance(x, float)]), str([x for x in r if isinstance(x, float)]))
    mine = sorted(map(tuple, got.select(*names).collect()), key=order)
    theirs = sorted(con.execute(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall(), key=order)
    wrong = [(a, b) for a, b in zip(mine, theirs) if not all(map(same, a, b))]
    assert len(mine) == len(theirs) and not wrong
