"""Streaming bars against the batch's."""

import math
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import bars
from barloom.sources import tables
from barloom.streaming import bars as streaming

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set(*streaming.PROVIDER)
    yield spark
    spark.conf.unset(streaming.PROVIDER[0])


def _files(spark, folder, frames):
    for f in frames:
        spark.createDataFrame(f).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(tables.trades(spark, SF).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _parts(spark, tmp_path, n=3, *, end=True):
    """The trades in n files by time, and one tick far ahead that moves the watermark past all."""
    t = tables.trades(spark, SF).orderBy("ts").toPandas()
    step = -(-len(t) // n)
    frames = [t[k * step : (k + 1) * step] for k in range(n)]
    last = t.iloc[[-1]].assign(ts=t.ts.max() + pd.Timedelta(days=9), symbol="end", trade_id=10**9)
    return _files(spark, tmp_path / "in", frames + [last, last] * end)


def _drain(df, tmp_path):
    name = f"t{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def rows(df, columns):
    short = lambda x: float(f"{x:.9g}") + 0.0 if isinstance(x, float) else x
    return sorted((tuple(map(short, r)) for r in df.select(*columns).collect()), key=str)


def same(got, want, columns):
    a, b = rows(got, columns), rows(want, columns)
    assert len(a) == len(b) and a
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-5, abs_tol=1e-6)) for p, q in zip(x, y)), (x, y)


TIMED = ("symbol", "start_time_ms", "end_time_ms", *bars.BASIC[2:], *bars.ADVANCED)
CUT = ("symbol", "bar_id", *bars.BASIC, *bars.ADVANCED)


def test_time_bars_equal_the_batch(spark, tmp_path):
    got = _drain(streaming.time_bars(_parts(spark, tmp_path), "4h"), tmp_path).filter("symbol <> 'end'")
    same(got, bars.time_bars(tables.trades(spark, SF), "4h", advanced=False), got.columns)


def test_quote_bars_equal_the_batch(spark, tmp_path):
    q = tables.quotes(spark, SF)
    last = q.orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("interval 9 days")).withColumn("symbol", F.lit("end"))
    for part in (q, last, last):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = _drain(streaming.quote_bars(stream, "1h"), tmp_path).filter("symbol <> 'end'")
    same(got, bars.quote_bars(q, "1h"), [c for c in got.columns if c not in ("open", "close")])  # ties of ts have no order


def test_moves_within_a_bar_equal_the_batch(rocks, tmp_path):
    got = _drain(streaming.time_bars(_parts(rocks, tmp_path, 5), "4h", advanced=True), tmp_path).filter("symbol <> 'end'")
    same(got, bars.time_bars(tables.trades(rocks, SF), "4h"), TIMED)


@pytest.mark.parametrize(("amount", "threshold"), [("volume", 100.0), ("dollar", 777.77)])
def test_threshold_bars_equal_the_batch(rocks, tmp_path, amount, threshold):
    got = _drain(streaming.threshold_bars(_parts(rocks, tmp_path), amount, threshold), tmp_path).filter("symbol <> 'end'")
    want = bars.threshold_bars(tables.trades(rocks, SF), amount, threshold).filter("is_complete")
    same(got, want, CUT)


@pytest.mark.parametrize("before_first", ["first", "drop"])
def test_daily_thresholds_and_open_bars_equal_the_batch(rocks, tmp_path, before_first):
    """After every trigger the bars given and the open ones are the batch's of what was read."""
    how = {"lookback": 3, "bars_per_day": 10, "discard_months": 0}
    t = tables.trades(rocks, SF).orderBy("ts").toPandas()
    step = -(-len(t) // 3)
    fold = streaming._fold_of("dollar", "auto", 3, 10, 0, before_first)
    for k in range(3):
        df = streaming.threshold_bars(_files(rocks, tmp_path / "in", [t[k * step : (k + 1) * step]]), "dollar", "auto", before_first=before_first, late="1 hours", **how)
        q = df.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        given = rocks.read.schema(df.schema).parquet(str(tmp_path / "out"))
        waiting = streaming.open_bars(rocks, str(tmp_path / "state"), fold, late="1 hours")
        assert waiting.filter("not is_complete").count() > 0
        want = bars.dollar_bars(rocks.createDataFrame(t[: (k + 1) * step]), "auto", before_first=before_first, **how)
        same(given.unionByName(waiting), want, (*CUT, "is_complete"))
    # What waits is the time that may be late and a slice, not the history.
    held = rocks.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state"))
    assert held.select(F.sum(F.length("user_map_value.ticks")) / streaming._TICK.itemsize).first()[0] < 0.1 * len(t)
    assert rocks.read.format("statestore").option("stateVarName", "days").load(str(tmp_path / "state")).groupBy("key.symbol").count().filter("count > 5").count() == 0


def test_open_time_bars(rocks, tmp_path):
    df = streaming.ordered_time_bars(_parts(rocks, tmp_path, 2, end=False), "4h")
    got = _drain(df, tmp_path)
    waiting = streaming.open_bars(rocks, str(tmp_path / "state"), streaming.TimeFold(4 * 3_600_000))
    assert waiting.filter("is_complete").count() == 0 and waiting.count() >= 1
    same(got.unionByName(waiting), bars.time_bars(tables.trades(rocks, SF), "4h"), TIMED)


def test_late_ticks_are_dropped_and_those_in_time_are_not(rocks, tmp_path):
    def frame(*ticks):
        return pd.DataFrame([("A", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m), k, float(p), 1.0, False) for k, (m, p) in enumerate(ticks)], columns=["symbol", "ts", "trade_id", "price", "quantity", "is_buyer_maker"])

    stream = _files(rocks, tmp_path / "in", [frame((0, 1), (30, 2)), frame((25, 9)), frame((5, 7), (90, 3)), frame((95, 3), (96, 3))])
    got = _drain(streaming.threshold_bars(stream, "volume", 1.0), tmp_path)
    assert [r.close for r in got.orderBy("bar_id").collect()] == [1.0, 9.0, 2.0]


def test_provider_and_lateness_are_asked_for(spark):
    stream = spark.readStream.schema(tables.trades(spark, SF).schema).parquet(SF + "/events.parquet")
    spark.conf.unset(streaming.PROVIDER[0])
    with pytest.raises(ValueError, match="RocksDB"):
        streaming.threshold_bars(stream, "volume", 1.0)
    with pytest.raises(ValueError, match="no lateness"):
        streaming._slice_ms("soon")
