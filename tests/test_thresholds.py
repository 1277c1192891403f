"""Thresholds made of days' totals."""

from pyspark.sql import functions as F

from barloom.operators import bars


def test_a_threshold_is_the_days_exact_total(spark):
    """Sums of doubles miss 300000300 by the order of ticks, and move a tick into the next bar."""
    t = spark.range(3001, numPartitions=3).select(
        F.lit("A").alias("symbol"),
        F.timestamp_millis(F.when(F.col("id") < 3000, F.col("id")).otherwise(86_400_000)).alias("ts"),
        F.col("id").alias("trade_id"),
        F.lit(100000.1).alias("price"),
        F.lit(1.0).alias("quantity"),
        F.lit(False).alias("is_buyer_maker"),
    )
    assert [r.total for r in bars.daily_profile(t).orderBy("day").collect()] == [300000300.0, 100000.1]
    got = bars.dollar_bars(t, "auto", lookback=1, bars_per_day=1, discard_months=0, advanced=False).orderBy("bar_id").collect()
    assert [(r.bar_id, r.tick_count, r.is_complete) for r in got] == [(0, 3000, True), (1, 1, False)]
