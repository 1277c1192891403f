"""Which symbols are traded when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import universe_filter


def top_by_volume(bars: DataFrame, n: int = 100, *, suffix: str = "", exclude: list[str] = ()) -> DataFrame:
    """(symbol, dollar_volume, rank): the n symbols with the largest dollar volume."""
    total = universe_filter(bars, suffix=suffix, exclude=list(exclude)).groupBy("symbol").agg(F.sum("dollar_volume").alias("dollar_volume"))
    # A row per symbol; the limit keeps n of each partition before they meet.
    best = total.orderBy(F.desc("dollar_volume"), "symbol").limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("dollar_volume"), "symbol")))


def reselect_dates(times: DataFrame, every: str = "month") -> DataFrame:
    """(reselect): the first timestamp in each month, quarter or day."""
    return times.groupBy(F.date_trunc(every, "ts").alias("p")).agg(F.min("ts").alias("reselect")).select("reselect")


def pools(bars: DataFrame, n: int, *, every: str = "month", days: int = 30) -> DataFrame:
    """(reselect, symbol, mean_volume, rank): at each reselection the n symbols of the
    largest mean dollar volume over the ``days`` before, that day's not included.

    The range join goes by whole days: a bar's day is sent to the reselections it
    counts for, at most one per ``days`` of look-back and period."""
    daily = bars.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.sum("dollar_volume").alias("v"), F.count("*").alias("c"))
    picks = reselect_dates(bars.select("ts").distinct(), every)
    reach = picks.select("reselect", F.explode(F.expr(f"sequence(date_sub(to_date(reselect), {days}), date_sub(to_date(reselect), 1), interval 1 day)")).alias("day"))
    mean = daily.join(reach, "day").groupBy("reselect", "symbol").agg((F.sum("v") / F.sum("c")).alias("mean_volume"))
    rank = F.row_number().over(Window.partitionBy("reselect").orderBy(F.desc("mean_volume"), "symbol"))
    return mean.withColumn("rank", rank).filter(F.col("rank") <= n)


def pool_at(pool: DataFrame, times: DataFrame) -> DataFrame:
    """(ts, symbol) of the pool that holds at each time: that of the last reselection.
    A reselection holds until the next; both meet by the days between."""
    picks = pool.select("reselect").distinct().withColumn("until", F.lead("reselect").over(Window.orderBy("reselect")))  # a row per reselection
    days = times.select("ts").distinct().withColumn("day", F.to_date("ts"))
    last = days.agg(F.max("day").alias("last"))
    spans = picks.crossJoin(F.broadcast(last)).select("reselect", "until", F.explode(F.expr("sequence(to_date(reselect), greatest(to_date(reselect), coalesce(to_date(until), last)), interval 1 day)")).alias("day"))
    held = days.join(spans, "day").filter("ts >= reselect and (until is null or ts < until)")
    return held.join(pool.select("reselect", "symbol"), "reselect").select("ts", "symbol")


def listing_times(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.min("ts").alias("listed"))
