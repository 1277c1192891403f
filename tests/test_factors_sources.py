"""Factors, analysis guards, sources and sinks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import analysis, bars, factors, panel, universe
from barloom.sources import tables, ticks

SF = "/root/testdata/sf0.001"


def test_raw_files_of_both_kinds(spark, tmp_path):
    (tmp_path / "maker.csv").write_text("1,10.5,2,1,1,1704067200000,true,true\n2,oops,2,1,1,1704067201000,False,true\n3,11,1,1,1,1704067202000,,true\n,,,,,,,\n")
    (tmp_path / "side.csv").write_text("7,10,3,sell,1704067200000\n8,10,4,BUY,1704067200001\n")
    (tmp_path / "quotes.csv").write_text("1,10,1,11,2,1704067200000,1704067200001\n2,10,1,,2,1704067200000,1704067200001\n")
    got = ticks.read_trade_csv(spark, str(tmp_path / "maker.csv"), "X").orderBy("trade_id").collect()
    assert [(r.trade_id, r.price, r.is_buyer_maker) for r in got] == [(1, 10.5, True), (3, 11.0, False)]
    assert got[0].ts == dt.datetime(2024, 1, 1)
    got = ticks.read_trade_csv(spark, str(tmp_path / "side.csv"), "X", side_based=True).orderBy("trade_id").collect()
    assert [(r.quantity, r.is_buyer_maker) for r in got] == [(3.0, True), (4.0, False)]
    assert ticks.read_quote_csv(spark, str(tmp_path / "quotes.csv"), "X").count() == 1
    ticks.csv_to_parquet(spark, str(tmp_path / "side.csv"), str(tmp_path / "raw"), ticks.SIDE_TRADE_COLUMNS)
    assert spark.read.parquet(str(tmp_path / "raw")).columns == list(ticks.SIDE_TRADE_COLUMNS)


@pytest.mark.parametrize(("unit", "factor"), [("s", 1), ("ms", 10**3), ("us", 10**6), ("ns", 10**9)])
def test_units_of_time(spark, unit, factor):
    df = spark.createDataFrame([(1_704_067_200 * factor,)], "t long").select(ticks.as_time(F.col("t"), unit=unit).alias("t"))
    assert df.first().t == dt.datetime(2024, 1, 1)


def test_ticks_and_bars_are_stored_by_month_and_pruned(spark, tmp_path):
    t = tables.trades(spark, SF)
    ticks.write_ticks(t, str(tmp_path / "t"))
    back = ticks.read_ticks(spark, str(tmp_path / "t"), symbols=["click"], start_month="2024-01", end_month="2024-01")
    assert back.count() == t.filter("symbol = 'click'").count()
    assert "PartitionFilters: [isnotnull(symbol" in back._jdf.queryExecution().toString()
    assert ticks.read_ticks(spark, str(tmp_path / "t"), start_month="2024-02").count() == 0
    b = bars.time_bars(t, "4h")
    ticks.write_bars(b, str(tmp_path / "b"))
    done, rest = spark.read.parquet(str(tmp_path / "b")), spark.read.parquet(str(tmp_path / "b_incomplete"))
    assert done.count() + rest.count() == b.count() and rest.count() == t.select("symbol").distinct().count()
    p = ticks.load_panel(spark, str(tmp_path / "b"), symbols=["view"], start="2024-01-02", end="2024-01-05", columns=["close"])
    assert p.columns == ["ts", "symbol", "close"] and 0 < p.count() <= 19


def test_factor_files_and_reports(spark, tmp_path):
    f = factors.compute(tables.panel(spark, SF), [factors.raw("close"), factors.roll("m", "close", "mean", 3)])
    for fmt in ("parquet", "csv"):
        ticks.write_factors(f, str(tmp_path / fmt), fmt)
        assert ticks.read_factors(spark, str(tmp_path / fmt), ["m"], fmt).count() == f.count() / 2
    ticks.write_report({"a": f.groupBy("factor").count()}, str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r/a"), header=True).count() == 2


def test_factors_that_lack_columns_are_left_out(spark):
    p = tables.panel(spark, SF)
    fs = [factors.raw("close"), factors.raw("nothing"), factors.roll("odd", "close", "median", 3)]
    good, bad = factors.usable(fs, p.columns)
    assert [f.name for f in good] == ["close"] and set(bad) == {"nothing", "odd"}
    assert factors.required(fs, ("volume",)) == {"close", "nothing", "volume"}
    assert {r.factor for r in factors.compute(p, fs).select("factor").distinct().collect()} == {"close"}


def test_windows_count_the_panels_timestamps(spark):
    day = [dt.datetime(2024, 1, d) for d in range(1, 5)]
    rows = [(day[k], "A", float(k)) for k in (0, 1, 2, 3)] + [(day[k], "B", float(k)) for k in (0, 3)]
    p = spark.createDataFrame(rows, "ts timestamp, symbol string, close double")
    got = {(r.symbol, r.ts.day): r.m for r in factors.wide(p, [factors.roll("m", "close", "mean", 2)]).collect()}
    assert got == {("A", 1): 0, ("A", 2): 0.5, ("A", 3): 1.5, ("A", 4): 2.5, ("B", 1): 0, ("B", 4): 3}


def test_pandas_factor_equals_the_column(spark):
    p = tables.panel(spark, SF)
    a = factors.apply_per_symbol(p, "m", lambda d: d["close"].rolling(3, min_periods=1).mean(), ["close"])
    assert a.count() == p.count() and a.columns == ["factor", "ts", "symbol", "value"]


def test_lost_rows_are_an_error(spark):
    p = tables.panel(spark, SF)
    f = factors.compute(p, [factors.roll("c", "close", "change", 28)])
    with pytest.raises(Exception, match="too much of a factor is lost"):
        analysis.clean(f, p.select("ts", "symbol", "close"), periods=[1], quantiles=3).collect()
    assert "loss" in analysis.clean(f, p.select("ts", "symbol", "close"), periods=[1], quantiles=3, max_loss=None).columns


def test_bins_equal_pandas(spark):
    pd = pytest.importorskip("pandas")
    rnd = random.Random(1)
    rows = [(dt.datetime(2024, 1, d), f"s{k}", float(rnd.randint(0, 30)), 0.0) for d in (1, 2) for k in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp, symbol string, value double, r double").withColumn("q", analysis.equal_count_bin("value", ["ts"], 5)).withColumn("w", analysis.equal_width_bin("value", ["ts"], 4))
    for _, g in df.toPandas().groupby("ts"):
        edges = g.value.quantile([0.2, 0.4, 0.6, 0.8]).to_numpy()
        assert (g.q == 1 + (edges[None, :] < g.value.to_numpy()[:, None]).sum(1)).all()
        assert (g.w == pd.cut(g.value, 4, labels=False) + 1).all()


def test_analysis_in_one_call(spark):
    p = tables.panel(spark, SF)
    prices = p.select("ts", "symbol", (100 + F.col("close") / 10).alias("close"))
    a = analysis.analyze(factors.compute(p, [factors.raw("close"), factors.raw("volume")]), prices, periods=[1, 2], quantiles=3)
    assert a.summary.count() == 4 and a.spread.count() == 2 and a.turnover.count() > 0


def test_warmup(spark):
    p = tables.panel(spark, SF)
    start = spark.range(1).select(panel.warmup_start("2024-03-05", 10, "1d").alias("t")).first().t
    assert start == dt.datetime(2024, 2, 1)
    assert panel.trim_warmup(p, "2024-01-10", 5).agg(F.min("ts").alias("t")).first().t == dt.datetime(2024, 1, 10)
    assert panel.trim_warmup(p, "2024-01-10", 0).count() == p.count()


def test_universe(spark):
    df = spark.createDataFrame([("AUSDT", 5.0), ("BUSDT", 9.0), ("CBTC", 99.0), ("USDCUSDT", 50.0)], "symbol string, dollar_volume double")
    got = universe.top_by_volume(df, 1, suffix="USDT", exclude=["USDCUSDT"]).collect()
    assert [(r.symbol, r["rank"]) for r in got] == [("BUSDT", 1)]
    h = tables.order_prices(spark, SF)
    pool = universe.pools(h, 2)
    held = universe.pool_at(pool, h)
    assert held.groupBy("ts").count().filter("count > 2").count() == 0 and held.count() > 0
