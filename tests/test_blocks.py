"""Windows by blocks against windows over whole histories."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import rolling, sliding
from barloom.operators import blocks, factors
from barloom.operators.panel import NUMBER, numbered


@pytest.fixture(scope="module")
def frame():
    rnd, rows = random.Random(9), []
    for symbol, n in (("A", 1000), ("B", 37), ("C", 1)):
        for k in range(n):
            x = None if rnd.random() < 0.1 or (symbol == "A" and 300 <= k < 520) else round(rnd.gauss(5, 3), 1)
            rows.append((dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * k), symbol, x, rnd.gauss(0, 1)))
    return pd.DataFrame(rows, columns=["ts", "symbol", "x", "y"])


@pytest.fixture(scope="module")
def panel(spark, frame):
    rows = [(r.ts.to_pydatetime(), r.symbol, None if r.x != r.x else float(r.x), float(r.y)) for r in frame.itertuples()]
    return spark.createDataFrame(rows, "ts timestamp, symbol string, x double, y double").repartition(5).cache()


def column(df, name):
    return {(r.symbol, r.ts): r[name] for r in df.collect()}


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert (a[k] is None) == (b[k] is None or b[k] != b[k]), k
        assert a[k] is None or a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9), k


def test_rows_are_numbered(panel, frame):
    got = column(blocks.numbered_rows(panel), blocks.ROW)
    assert got == {(r.symbol, r.ts): k for _, g in frame.sort_values("ts").groupby("symbol") for k, r in enumerate(g.itertuples())}


@pytest.mark.parametrize("size", [100, 7])
def test_windows_by_blocks(panel, size):
    def made(how):
        return {"mean": rolling.mean("x", 20, **how), "std": rolling.std("x", 20, **how), "z": rolling.zscore("x", 20, **how), "top": rolling.highest("x", 20, **how), "d": rolling.diff("x", 3, **how), "beta": rolling.slope("x", "y", 20, **how)}

    got = blocks.windows(panel, 19, made, size=size)
    want = panel.select("*", *[x.alias(n) for n, x in made({}).items()])
    assert got.columns == want.columns
    for name in made({}):
        close(column(got, name), column(want, name))


def test_windows_that_count_timestamps(panel):
    made = lambda how: {"mean": rolling.mean("x", 9, **how), "z": rolling.zscore("x", 30, **how)}
    n = numbered(panel)
    got = blocks.windows(n, 29, made, number=NUMBER, size=100)
    want = n.select("*", *[x.alias(k) for k, x in made({"number": NUMBER}).items()])
    for name in ("mean", "z"):
        close(column(got, name), column(want, name))


def test_a_symbols_rows_are_many_tasks_and_come_twice_at_most(panel):
    spread = blocks.halo(blocks.numbered_rows(panel), 50, size=100)
    assert spread.filter(f"symbol = 'A' and {blocks.OWN}").select(blocks.BLOCK).distinct().count() == 10
    assert spread.groupBy("symbol", blocks.BLOCK).count().agg(F.max("count")).first()[0] <= 150
    assert spread.count() < 1.6 * panel.count() and spread.filter(blocks.OWN).count() == panel.count()


def test_pandas_factor_by_blocks(panel):
    f = lambda d: d["x"].rolling(30, min_periods=2).median()
    got, want = blocks.apply_per_block(panel, "m", f, ["x"], 29, size=100), factors.apply_per_symbol(panel, "m", f, ["x"])
    close({(r.symbol, r.ts): r.value for r in got.collect()}, {(r.symbol, r.ts): r.value for r in want.collect()})


@pytest.mark.parametrize("size", [100, 9, 4096])
def test_exponential_means_have_no_cut(panel, frame, size):
    got = blocks.exponential(panel, {"a": ("x", 10), "b": ("x", 300), "c": ("y", 1)}, size=size)
    for name, x, span in (("a", "x", 10), ("b", "x", 300), ("c", "y", 1)):
        want = {}
        for s, g in frame.sort_values("ts").groupby("symbol"):
            for t, v in zip(g.ts, g[x].ewm(span=span, adjust=True, ignore_na=False).mean()):
                want[s, t.to_pydatetime()] = v
        close(column(got, name), want)


@pytest.mark.parametrize("size", [100, 3])
def test_last_known(panel, frame, size):
    got = column(blocks.last_known(panel, {"f": "x"}, size=size), "f")
    close(got, {(r.symbol, r.ts.to_pydatetime()): r.f for r in frame.sort_values("ts").assign(f=lambda d: d.groupby("symbol").x.ffill()).itertuples()})


@pytest.mark.parametrize("size", [100, 5])
def test_positions_against_a_state_machine(panel, frame, size):
    c = F.col("y")
    got = column(blocks.positions(panel, long=c < -1.5, leave_long=(c > 0.2) & (c < 3), short=(c > 1.5) | (c < -2.2), leave_short=c < -0.2, size=size), "position")
    for s, g in frame.sort_values("ts").groupby("symbol"):
        state = 0
        for t, y in zip(g.ts, g.y):
            up, down = y < -1.5, y > 1.5 or y < -2.2
            if up:
                state = 1
            elif down:
                state = -1
            elif (state == 1 and 0.2 < y < 3) or (state == -1 and y < -0.2):
                state = 0
            assert got[s, t.to_pydatetime()] == state
    assert set(got.values()) == {-1, 0, 1}


def test_order_statistics_by_blocks(panel, frame):
    got = blocks.order_statistics(panel, {"q": ("x", 50, 0.9), "r": ("x", 50, None), "m": ("y", 7, 0.5)}, size=60)
    assert got.columns == ["ts", "symbol", "x", "y", "q", "r", "m"]
    g = frame.sort_values("ts").groupby("symbol")
    want = frame.sort_values("ts").assign(q=g.x.transform(lambda v: v.rolling(50, min_periods=1).quantile(0.9)), r=g.x.transform(lambda v: v.rolling(50, min_periods=1).rank(pct=True)), m=g.y.transform(lambda v: v.rolling(7, min_periods=1).median()))
    for name in ("q", "r", "m"):
        close(column(got, name), {(r.symbol, r.ts.to_pydatetime()): getattr(r, name) for r in want.itertuples()})


def test_sliding_values_and_their_cost():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 3000).astype(float)
    x[rng.random(3000) < 0.1] = np.nan
    s = pd.Series(x)
    for n in (1, 3, 500, 2999):
        assert np.allclose(sliding.quantile(x, n, 0.37), s.rolling(n, min_periods=1).quantile(0.37), equal_nan=True)
        assert np.allclose(sliding.rank(x, n), s.rolling(n, min_periods=1).rank(pct=True), equal_nan=True)
    y = rng.random(20_000)
    spent = {}
    for n in (500, 5000):
        start = time.process_time()
        sliding.quantile(y, n, 0.9)
        spent[n] = time.process_time() - start
    assert spent[5000] < 4 * spent[500]  # ten times the window
