"""Expected values of holding returns and long-short backtests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import backtest

T = [dt.datetime(2024, 1, d) for d in (1, 8, 15, 22, 29)]


def prices(spark, table):
    rows = [(T[k], s, None if p is None else float(p)) for s, ps in table.items() for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, "ts timestamp, symbol string, close double")


def data(spark, quantiles, dates):
    """quantiles: {symbol: quantile, or one per date}."""
    rows = [("f", T[k], s, q[k] if isinstance(q, (list, tuple)) else q) for s, q in quantiles.items() for k in range(dates)]
    return spark.createDataFrame([r for r in rows if r[3]], "factor string, ts timestamp, symbol string, quantile int")


@pytest.mark.parametrize(
    ("table", "asked", "expected"),
    [
        ({"A": (100, 120), "B": (100, 90)}, ["A", "B"], 0.05),
        ({"X": (100, 150)}, ["X"], 0.5),
        ({"X": (100, 150)}, [], 0.0),
        ({"A": (100, 120)}, ["A", "MISSING"], 0.2),
        ({"A": (100, 120)}, ["X", "Y"], 0.0),
        ({"A": (200, 100)}, ["A"], -0.5),
        ({"A": (100, 120), "B": (100, None)}, ["A", "B"], 0.2),
        ({"A": (100, 100), "B": (50, 50)}, ["A", "B"], 0.0),
    ],
)
def test_holding_return(spark, table, asked, expected):
    got = backtest.holding_return(prices(spark, table), "2024-01-01", "2024-01-08", asked)
    assert got == pytest.approx(expected, abs=1e-10)


BASE = {"A": (100, 110, 121), "B": (100, 100, 100), "C": (100, 90, 81)}
BASE_Q = {"A": 2, "B": 1, "C": 1}


def run(spark, table, quantiles, dates, **how):
    rows = backtest.long_short(data(spark, quantiles, dates), prices(spark, table), **how)
    return rows.orderBy("ts").collect(), [r.nav for r in backtest.nav(rows).orderBy("ts").collect()]


def test_base_case(spark):
    rows, nav = run(spark, BASE, BASE_Q, 3)
    assert len(rows) == 2
    assert (rows[0].long_return, rows[0].short_return, rows[0].gross) == pytest.approx((0.10, -0.05, 0.15))
    assert nav == pytest.approx([1, 1.15, 1.3225])


def test_costs(spark):
    rows, nav = run(spark, BASE, BASE_Q, 3, cost_bps=100)
    assert [r.cost for r in rows] == pytest.approx([0.02, 0])
    assert nav == pytest.approx([1, 1.13, 1.2995])


def test_swap_of_quantiles_turns_over(spark):
    rows, _ = run(spark, BASE, {"A": (2, 1, 1), "B": (1, 2, 2), "C": 1}, 3)
    assert [r.turnover for r in rows] == pytest.approx([2.0, 3.0])


def test_same_quantile_on_both_sides_nets_to_nothing(spark):
    rows, _ = run(spark, BASE, BASE_Q, 3, long_quantile=1, short_quantile=1)
    assert [r.gross for r in rows] == pytest.approx([0, 0])
    assert [r.turnover for r in rows] == pytest.approx([0, 0])


def test_chosen_quantiles(spark):
    rows, _ = run(spark, {"A": (100, 100), "B": (100, 110), "C": (100, 130)}, {"A": 1, "B": 2, "C": 3}, 2, long_quantile=2, short_quantile=3)
    assert rows[0].gross == pytest.approx(-0.2)


def test_weekly_growth(spark):
    table = {"A": [100 * 1.1**k for k in range(5)], "B": [100] * 5}
    _, nav = run(spark, table, {"A": 2, "B": 1}, 5)
    assert nav == pytest.approx([1.1**k for k in range(5)])


def test_short_leg_doubles(spark):
    rows, nav = run(spark, {"A": (100, 105), "B": (100, 200)}, {"A": 2, "B": 1}, 2)
    assert rows[0].gross == pytest.approx(-0.95) and nav[-1] == pytest.approx(0.05)


def test_four_longs_one_short(spark):
    table = {"A": (100, 110), "B": (100, 120), "C": (100, 130), "D": (100, 140), "E": (100, 80)}
    rows, _ = run(spark, table, {"A": 2, "B": 2, "C": 2, "D": 2, "E": 1}, 2)
    assert (rows[0].long_return, rows[0].short_return, rows[0].gross) == pytest.approx((0.25, -0.20, 0.45))


def test_single_date(spark):
    d = data(spark, BASE_Q, 1)
    rows = backtest.long_short(d, prices(spark, BASE))
    assert rows.count() == 0
    assert [r.nav for r in backtest.nav(rows, dates=d).collect()] == [1.0]


def test_dates_with_empty_legs_close_positions(spark):
    rows, _ = run(spark, BASE, {"A": (3, 2, 3), "B": (1, 2, 1), "C": (1, 2, 1)}, 3)
    assert rows[1].gross == 0 and rows[1].turnover == pytest.approx(2.0)


def test_performance_and_trading(spark):
    rows = backtest.long_short(data(spark, BASE_Q, 3), prices(spark, BASE), cost_bps=100)
    perf, traded = backtest.performance(backtest.nav(rows)).first(), backtest.trading(rows).first()
    assert perf.total_return == pytest.approx(0.2995)
    assert (traded.n_rebalances, traded.total_cost) == (2, pytest.approx(0.02))


def test_weights_as_input_give_the_same(spark):
    d, p = data(spark, BASE_Q, 3), prices(spark, BASE)
    w = backtest.leg_weights(d).groupBy("factor", "ts", "symbol").agg(F.sum("weight").alias("weight"))
    a, b = backtest.from_weights(w, p, cost_bps=10).orderBy("ts").collect(), backtest.long_short(d, p, cost_bps=10).orderBy("ts").collect()
    assert [(r.gross, r.net) for r in a] == [pytest.approx((r.gross, r.net)) for r in b]
