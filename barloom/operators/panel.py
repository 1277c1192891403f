"""Panels: (ts, symbol, columns...), in long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Column with the number of a row's timestamp among the panel's.
NUMBER = "__number"


def numbered(panel: DataFrame) -> DataFrame:
    """The panel with its timestamps' numbers, from 1. Windows over a range of numbers
    (``number=NUMBER`` of functions.rolling) then count the panel's timestamps, not a
    symbol's own rows, without a row for every absent cell. Timestamps are counted by
    day; what stands in one order has a row per day."""
    times = panel.select("ts").distinct().withColumn("__day", F.to_date("ts"))
    days = times.groupBy("__day").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("__day").orderBy("ts"))
    numbers = times.join(days.select("__day", before.alias("__before")), "__day").select("ts", (own + F.col("__before")).alias(NUMBER))
    return panel.join(numbers, "ts")


def finite(column: str) -> Column:
    """The column with null for NaN and infinities."""
    x = F.col(column)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def finite_only(df: DataFrame, column: str) -> DataFrame:
    """NaN and infinities become null, then null rows go."""
    return df.withColumn(column, finite(column)).filter(F.col(column).isNotNull())


def trim_warmup(df: DataFrame, start: str, warmup: int) -> DataFrame:
    """Rows from ``start`` on; all, without warm-up."""
    return df.filter(F.col("ts") >= F.lit(start).cast("timestamp")) if warmup > 0 else df


def warmup_start(start: str, warmup: int, interval: str):
    """``start`` less ``warmup`` intervals, at the beginning of its month, as a Column."""
    from .bars import interval_ms

    shifted = F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) - warmup * interval_ms(interval))
    return F.date_trunc("month", shifted)


def universe_filter(df: DataFrame, *, suffix: str = "USDT", exclude: list[str] = ()) -> DataFrame:
    """Symbols with the quote suffix that aren't in the exclude set."""
    keep = F.col("symbol").endswith(suffix)
    return df.filter(keep & ~F.col("symbol").isin(list(exclude)) if exclude else keep)


def every_nth(df: DataFrame, n: int) -> DataFrame:
    """The rows of every n-th timestamp, from the first."""
    return numbered(df).filter((F.col(NUMBER) - 1) % n == 0).select(*df.columns)
