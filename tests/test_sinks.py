"""Sinks that are written part by part, and threshold bars month by month."""

import datetime as dt
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars, factors, resume
from barloom.sources import tables, ticks
from barloom.sources.stored import Store

SF = "/root/testdata/sf0.001"
TRADES = "symbol string, ts timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean"
MONTHS = ("2024-01", "2024-02", "2024-03")


@pytest.fixture(scope="module")
def trades(spark):
    """Three months; one symbol begins late, one has no tick in February."""
    rnd, rows = random.Random(8), []
    for symbol, first, gap in (("A", 0, ()), ("B", 45, ()), ("C", 0, range(31, 60))):
        for day in range(first, 90):
            for _ in range(6 if day not in gap else 0):
                at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=rnd.randrange(86_400))
                rows.append((symbol, at, len(rows), round(rnd.uniform(90, 110), 2), rnd.choice((0.0, 1.0, 2.5, 7.125, 40.0)), rnd.random() < 0.5))
    return spark.createDataFrame(rows, TRADES).withColumn("ts", F.col("ts")).cache()


def of(trades, month):
    return trades.filter(F.date_format("ts", "yyyy-MM") == month)


def rows(df, *columns):
    short = lambda x: float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(short, r)) for r in df.select(*(columns or sorted(df.columns))).collect()), key=str)


def test_a_second_month_leaves_the_first(spark, trades, tmp_path):
    path = str(tmp_path / "t")
    for month in (*MONTHS, MONTHS[1], MONTHS[1]):
        ticks.write_ticks(of(trades, month), path)
    assert rows(ticks.read_ticks(spark, path).drop("month")) == rows(trades)
    ticks.write_ticks(of(trades, MONTHS[0]).filter("symbol = 'A'").limit(3), path)
    back = ticks.read_ticks(spark, path)
    assert back.filter("symbol = 'A' and month = '2024-01'").count() == 3
    assert back.filter("symbol = 'C'").count() == trades.filter("symbol = 'C'").count()


def test_bars_by_month_and_only_the_latest_open_ones(spark, trades, tmp_path):
    path = str(tmp_path / "b")
    every = bars.time_bars(trades, "4h")
    for month in MONTHS:
        part = every.filter(F.col("month") == month)
        open_now = part.groupBy("symbol").agg(F.max("bar_id").alias("bar_id")).withColumn("last", F.lit(True))
        ticks.write_bars(part.join(open_now, ["symbol", "bar_id"], "left").withColumn("is_complete", F.col("last").isNull()).drop("last"), path)
    done, rest = spark.read.parquet(path), spark.read.parquet(f"{path}_incomplete")
    assert rest.groupBy("symbol").count().filter("count > 1").count() == 0 and rest.count() == 3
    assert done.select("month").distinct().count() == 3
    before = rows(done)
    ticks.write_bars(every.filter("is_complete and month = '2024-02'"), path)
    assert spark.read.parquet(path).filter("month <> '2024-02'").count() == len([r for r in before if "2024-02" not in r])


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_second_factor_and_month_leave_the_first(spark, tmp_path, fmt):
    path, p = str(tmp_path / fmt), tables.panel(spark, SF)
    a = factors.compute(p, [factors.raw("close")])
    b = factors.compute(p, [factors.roll("m", "close", "mean", 3)])
    later = a.withColumn("ts", F.col("ts") + F.expr("interval 3 months"))
    for _ in range(2):
        for part in (a, b, later):
            ticks.write_factors(part, path, fmt)
    back = ticks.read_factors(spark, path, fmt=fmt)
    assert rows(back, "factor", "ts", "symbol") == rows(a.unionByName(b).unionByName(later).withColumn("symbol", F.col("symbol").cast(back.schema["symbol"].dataType)), "factor", "ts", "symbol")


def test_a_failed_write_leaves_what_was_there(spark, trades, tmp_path):
    path = str(tmp_path / "t")
    ticks.write_ticks(of(trades, MONTHS[0]), path)
    bad = of(trades, MONTHS[0]).withColumn("price", F.when(F.col("trade_id") % 50 == 7, F.raise_error(F.lit("broken")).cast("double")).otherwise(0.0))
    with pytest.raises(Exception, match="broken"):
        ticks.write_ticks(bad, path)
    assert rows(ticks.read_ticks(spark, path).drop("month")) == rows(of(trades, MONTHS[0]))


def test_stored_tables_go_with_their_handle(spark):
    with Store(spark) as store:
        t = store(spark.range(5), "five")
        assert t.count() == 5
        folder = store.folder
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


HOW = {"lookback": 3, "bars_per_day": 2, "discard_months": 1}


@pytest.mark.parametrize(("amount", "threshold"), [("dollar", 1777.77), ("volume", 33.3), ("dollar", "auto"), ("volume", "auto")])
def test_month_by_month_equals_all_at_once(spark, trades, tmp_path, amount, threshold):
    path, state = str(tmp_path / "b"), str(tmp_path / "s")
    how = HOW if threshold == "auto" else {}
    for month in MONTHS[:2]:
        resume.extend(of(trades, month), path, state, month, amount, threshold, **how)
    # A month may be run again.
    for month in MONTHS[1:]:
        resume.extend(of(trades, month), path, state, month, amount, threshold, **how)
    want = bars.adaptive_bars(trades, amount, threshold, **how)
    columns = ("symbol", "bar_id", *bars.BASIC, *bars.ADVANCED)
    got, rest = spark.read.parquet(path), spark.read.parquet(f"{path}_incomplete")
    mine, theirs = rows(got, *columns), rows(want.filter("is_complete"), *columns)
    assert len(mine) == len(theirs) > 20
    for a, b in zip(mine, theirs):
        assert a == tuple(pytest.approx(x, rel=1e-6, abs=1e-6) if isinstance(x, float) else x for x in b)
    open_now = {r.symbol: (r.bar_id, round(r.volume, 6)) for r in want.filter("not is_complete").collect()}
    assert {r.symbol: (r.bar_id, round(r.volume, 6)) for r in rest.collect()} == open_now
    # What is left is the open bar's ticks, not the history.
    assert resume.left(spark, state, "ticks").count() < 0.2 * trades.count()


def test_an_unknown_threshold_is_an_error(spark, trades):
    with pytest.raises(ValueError, match="no threshold"):
        bars.volume_bars(trades, "automatic")


SESSION = """
import os, sys
from pyspark.sql import SparkSession
from barloom.sources.stored import Store, stored
folder = sys.argv[1]
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", folder).getOrCreate()
kept = stored(spark.range(5), "kept")
with Store(spark) as store:
    assert store(spark.range(3), "inner").count() == 3 and any(n.startswith("store-") for n in os.listdir(folder))
assert not any(n.startswith("store-") for n in os.listdir(folder))
assert kept.count() == 5 and any(n.startswith("kept-") for n in os.listdir(folder))
spark.stop()
"""


def test_stored_tables_go_with_their_block_or_with_the_session(tmp_path):
    subprocess.run([sys.executable, "-c", SESSION, str(tmp_path)], cwd=Path(__file__).parent.parent, check=True, timeout=300)
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith(("kept-", "store-"))]
