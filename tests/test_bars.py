"""Bars: cases by hand, conservation, and a sequential loop."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars
from barloom.sources import tables

SF = "/root/testdata/sf0.001"
TRADES = "symbol string, ts timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean"


def ticks(spark, rows, day=dt.datetime(2024, 1, 1)):
    """(seconds, price, quantity) rows."""
    return spark.createDataFrame([("A", day + dt.timedelta(seconds=t), k, float(p), float(q), k % 2 == 0) for k, (t, p, q) in enumerate(rows)], TRADES)


def test_intervals():
    assert [bars.interval_ms(x) for x in ("500ms", "30s", "5min", "5m", "4h", "1d", "1w")] == [500, 30_000, 300_000, 300_000, 14_400_000, 86_400_000, 604_800_000]
    for bad in ("5", "x", "0s", "5y"):
        with pytest.raises(ValueError):
            bars.interval_ms(bad)


def test_volume_bars_by_hand(spark):
    t = ticks(spark, [(0, 1, 4), (1, 2, 16), (2, 3, 1), (3, 9, 0)])
    got = bars.volume_bars(t, 10).orderBy("bar_id").collect()
    base = got[0].start_time_ms
    assert [(r.start_time_ms - base, r.end_time_ms - base, r.volume, r.tick_count, r.is_complete) for r in got] == [(0, 1000, 10, 2, True), (1000, 1000, 10, 1, True), (1000, 2000, 1, 1, False)]
    assert got[0].dollar_volume == 16


def test_one_tick_over_two_dollar_bars_keeps_its_quantity(spark):
    got = bars.dollar_bars(ticks(spark, [(0, 1, 10)]), 5).collect()
    assert sorted((r.dollar_volume, r.volume) for r in got) == [(5, 5), (5, 5)]


def test_single_tick_time_bar(spark):
    r = bars.time_bars(ticks(spark, [(0, 5, 1)]), "1h").first()
    assert (r.price_std, r.skewness, r.kurtosis, r.path_efficiency, r.tick_interval_mean, r.is_complete) == (0, 0, 0, 1, 0, False)


def test_moves(spark):
    r = bars.time_bars(ticks(spark, [(0, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]), "1h").first()
    assert (r.up_move_ratio, r.down_move_ratio, r.reversals, r.path_efficiency) == (0.25, 0.25, 1, 0)


def test_weeks_begin_on_thursdays(spark):
    r = bars.time_bars(ticks(spark, [(0, 1, 1)], dt.datetime(2024, 1, 3)), "1w").select(F.timestamp_millis("start_time_ms").alias("t")).first()
    assert r.t == dt.datetime(2023, 12, 28)


def test_auto_threshold(spark):
    profile = spark.createDataFrame([("A", d, v) for d, v in enumerate((100.0, 200.0, 300.0))], "symbol string, day long, total double")
    got = bars.daily_thresholds(profile, lookback=2, bars_per_day=10, discard_months=0).orderBy("day").collect()
    assert [(r.day, r.threshold) for r in got] == [(1, 10), (2, 15)]
    with pytest.raises(ValueError):
        bars.daily_thresholds(profile, lookback=0)


def test_no_threshold_is_an_error(spark):
    with pytest.raises(Exception, match="too little history"):
        bars.dollar_bars(ticks(spark, [(0, 1, 1)]), "auto").collect()


def test_too_small_threshold_is_an_error(spark):
    with pytest.raises(Exception, match="too many bars"):
        bars.volume_bars(ticks(spark, [(0, 1, 10**7)]), 0.001).collect()


@pytest.mark.parametrize(("amount", "threshold"), [("volume", 37.0), ("dollar", 777.77)])
def test_fixed_bars_equal_a_loop(spark, amount, threshold):
    t = tables.trades(spark, SF)
    got = {(r.symbol, r.bar_id): r for r in bars.threshold_bars(t, amount, threshold).collect()}
    want, limit = {}, round(threshold * 10**8)
    held, number = {}, {}
    for r in t.orderBy("symbol", "ts", "trade_id").collect():
        left = round(round(r.price * r.quantity, 6) * 10**8) if amount == "dollar" else round(r.quantity * 10**8)
        while left > 0:
            part = min(left, limit - held.get(r.symbol, 0))
            bar = want.setdefault((r.symbol, number.get(r.symbol, 0)), [0, 0, r.price, r.price])
            bar[0] += part
            bar[1] += 1
            bar[3] = r.price
            left -= part
            held[r.symbol] = held.get(r.symbol, 0) + part
            if held[r.symbol] == limit:
                held[r.symbol], number[r.symbol] = 0, number.get(r.symbol, 0) + 1
    assert got.keys() == want.keys()
    for k, (total, n, first, last) in want.items():
        r = got[k]
        assert (r.tick_count, r.open, r.close) == (n, first, last)
        assert (r.dollar_volume if amount == "dollar" else r.volume) == pytest.approx(total / 1e8, abs=1e-6)
        assert r.is_complete == (total == limit)
    whole = t.filter("price * quantity > 0").agg(F.sum("quantity").alias("q")).first().q
    assert sum(r.volume for r in got.values()) == pytest.approx(whole)


def test_quote_bars_clip_crossed_books(spark):
    q = spark.createDataFrame([("A", dt.datetime(2024, 1, 1, 0, 0, s), 10.0, 1.0, a, 1.0) for s, a in enumerate((9.0, 9.5))], "symbol string, ts timestamp, best_bid_price double, best_bid_qty double, best_ask_price double, best_ask_qty double")
    r = bars.quote_bars(q, "1h").first()
    assert (r.spread_max, r.tick_count, r.open, r.close) == (0, 2, 9.5, 9.75)


def test_empty_input(spark):
    empty = spark.createDataFrame([], TRADES)
    assert bars.time_bars(empty, "1h").count() == bars.volume_bars(empty, 5).count() == bars.tick_bars(empty, 5).count() == 0


def test_random_thresholds_by_day_conserve(spark):
    rnd = random.Random(4)
    rows = [("A", dt.datetime(2024, 1, 1 + k // 50, 1, 0, k % 50), k, float(rnd.randint(1, 9)), float(rnd.randint(0, 9)), False) for k in range(300)]
    t = spark.createDataFrame(rows, TRADES)
    thr = spark.createDataFrame([("A", 19723 + d, float(rnd.randint(20, 400))) for d in range(1, 6)], "symbol string, day long, threshold double")
    got = bars.threshold_bars(t, "dollar", thr, advanced=False)
    assert got.agg(F.sum("dollar_volume").alias("x")).first().x == pytest.approx(sum(r[3] * r[4] for r in rows))
