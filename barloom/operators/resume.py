"""Threshold bars month by month.

A run reads one month's ticks and what the run before it left: per symbol the number of
closed bars, the time at which the open one begins and the ticks in it, the first of them
cut, and with daily thresholds the days' totals. It writes the month's bars and what it leaves
in turn. So only the new month is read, and the bars are those of one run over all months.
A month may be run again: it replaces its own bars and what it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import Store
from ..sources.ticks import replace_partitions
from . import bars

_TICK = ("symbol", "ts", "trade_id", "price", "quantity", "is_buyer_maker")
_LEFT = {
    "ticks": f"symbol string, ts timestamp, trade_id long, price double, quantity double, is_buyer_maker boolean, exact {bars.AMOUNT}",
    "opened": "symbol string, bars long, begin_ms long",
    "profile": "symbol string, day long, total double",
}


def left(spark: SparkSession, state: str, kind: str, before: str | None = None) -> DataFrame:
    """What the latest run, or the latest one for a month before ``before``, left."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/{kind}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _LEFT[kind])
    df = spark.read.schema(f"{_LEFT[kind]}, after string").parquet(f"{state}/{kind}")
    # Whether a run left rows or not, its mark is in the list of runs.
    runs = spark.read.schema("n int, after string").parquet(f"{state}/runs")
    last = (runs.filter(F.col("after") < before) if before else runs).agg(F.max("after").alias("m")).first().m
    return df.filter(F.col("after") == F.lit(last)).drop("after")


def extend(ticks: DataFrame, bars_path: str, state: str, month: str, amount: str, threshold: float | str = "auto", *, lookback: int = 10, bars_per_day: int = 50, discard_months: int = 1, advanced: bool = True) -> None:
    """Adds the bars of ``month`` (yyyy-MM), whose trades ``ticks`` are, to those under
    ``bars_path``, with the open ones beside them as ``sources.ticks.write_bars`` has it. Symbols for
    which no threshold is known yet keep their ticks until one is."""
    spark = ticks.sparkSession
    new = ticks.select(*_TICK)
    opened, carried = left(spark, state, "opened", month), left(spark, state, "ticks", month)
    every = carried.unionByName(new, allowMissingColumns=True)
    with Store(spark) as store:
        profile = None
        if threshold == "auto":
            days = left(spark, state, "profile", month).unionByName(bars.daily_profile(new, amount))
            profile = store(days.groupBy("symbol", "day").agg(F.sum("total").alias("total")), "profile")
            threshold = bars.daily_thresholds(profile, lookback=lookback, bars_per_day=bars_per_day, discard_months=discard_months)
            known = threshold.select("symbol").distinct()
            ready, waits = every.join(known, "symbol", "left_semi"), every.join(known, "symbol", "left_anti")
        else:
            ready, waits = every, None
        made = store(bars.threshold_bars(ready, amount, threshold, advanced=advanced, opened=opened, resumable=True), "bars")
        out = made.drop("first").withColumn("month", F.date_format(F.timestamp_millis("end_time_ms"), "yyyy-MM"))
        replace_partitions(out.filter("is_complete").drop("is_complete"), ("symbol", "month"), bars_path)
        replace_partitions(out.filter("not is_complete").drop("is_complete"), ("symbol",), f"{bars_path.rstrip('/')}_incomplete")

        # Of the open bar: its first piece, and the ticks after that.
        now = made.filter("not is_complete").select("symbol", "first")
        later = F.struct("ts", "trade_id") > F.struct("first.ts", "first.trade_id")
        # A symbol's open bar is one row, so the join leaves the ticks where they are dealt by symbol.
        rest = ready.join(now, "symbol").filter(later & (F.col("price") * F.col("quantity") > 0)).drop("first")
        held = now.select("symbol", "first.*").unionByName(rest, allowMissingColumns=True)
        last = made.groupBy("symbol").agg(F.max_by(F.struct("bar_id", "is_complete", "start_time_ms", "end_time_ms"), "bar_id").alias("b"))
        went = last.select("symbol", F.expr("b.bar_id + cast(b.is_complete as int)").alias("bars"), F.expr("case when b.is_complete then b.end_time_ms when b.bar_id > 0 then b.start_time_ms end").alias("begin_ms"))
        # Symbols without a tick this month stay as they were.
        went = went.unionByName(opened.join(went, "symbol", "left_anti"))
        tables = {"ticks": held if waits is None else held.unionByName(waits, allowMissingColumns=True), "opened": went} | ({"profile": profile} if profile is not None else {})
        for kind, df in tables.items():
            stays = store(df, f"left-{kind}")
            replace_partitions(stays.withColumn("after", F.lit(month)), ("after",), f"{state}/{kind}")
        # The run counts once this is written.
        replace_partitions(spark.range(1).select(F.col("id").cast("int").alias("n"), F.lit(month).alias("after")), ("after",), f"{state}/runs")
