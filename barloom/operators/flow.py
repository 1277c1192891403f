"""Features of a bar's ticks that measure informed trading.

Definitions, where a paper has one: VPIN (Easley, Lopez de Prado, O'Hara 2012), the mean
imbalance of the last equal-volume buckets, sides as the ticks tell them; jump ratio
(Barndorff-Nielsen, Shephard 2004), the share of the realized variance above the bipower
variation; burstiness (Goh, Barabasi 2008), deviation less mean of the gaps between ticks
over their sum. Ours: runs are ticks of one side in a row, whales the ticks of at least the
bar's 90 % quantity.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling
from . import bars, blocks

FEATURES = ("jump_ratio", "burstiness", "toxicity_run_mean", "toxicity_run_max", "toxicity_ratio", "whale_imbalance", "whale_impact")


def vpin(trades: DataFrame, volume: float | DataFrame | str = "auto", *, buckets: int = 50, **how) -> DataFrame:
    """(symbol, bar_id, end_time_ms, vpin): a row per full bucket of ``volume``, null before
    there are ``buckets`` of them. Buckets are volume bars; ``how`` goes to them."""
    full = bars.volume_bars(trades, volume, advanced=False, **how).filter("is_complete")
    share = full.withColumn("__share", F.try_divide(F.abs(F.col("buy_volume") - F.col("sell_volume")), F.col("volume")))
    made = blocks.windows(share, buckets - 1, lambda w: {"vpin": rolling.mean("__share", buckets, buckets, **w)}, number="bar_id")
    return made.select("symbol", "bar_id", "end_time_ms", "vpin")


def features(trades: DataFrame, interval: str, *, quantile: float = 0.9) -> DataFrame:
    """(symbol, ts, FEATURES): a row per symbol and interval that has ticks.

    ``jump_ratio`` is null without a return that isn't 0, ``burstiness`` without a gap over 0,
    the whales' columns without quantity. ``toxicity_ratio`` is the longest run's share of
    ticks, ``whale_imbalance`` that of whales' bought less sold quantity, ``whale_impact``
    their price steps, in the direction of their sides, by their quantity."""
    ms = bars.interval_ms(interval)
    group = Window.partitionBy("symbol", "edge")
    w = group.orderBy("ts", "trade_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    c, before = F.col, lambda x: F.lag(x).over(w)
    t = trades.withColumn("ms", F.unix_millis("ts")).withColumn("edge", c("ms") - F.pmod("ms", F.lit(ms))).withColumn("side", F.when(c("is_buyer_maker"), -1).otherwise(1))
    t = t.withColumns({"step": c("price") - before("price"), "gap": c("ms") - before("ms"), "turn": F.coalesce(c("side") != before("side"), F.lit(True)), "place": F.row_number().over(w), "r": F.when((c("price") > 0) & (before("price") > 0), F.ln(c("price") / before("price")))})
    t = t.withColumns({"pair": F.abs("r") * F.abs(before("r")), "run": c("place") - F.max(F.when(c("turn"), c("place"))).over(so_far) + 1, "whale": c("quantity") >= F.percentile("quantity", F.lit(quantile)).over(group)})
    rv, bv = F.sum(c("r") * c("r")), F.coalesce(F.sum("pair"), F.lit(0.0)) * (pi / 2)
    whales = F.sum(F.when(c("whale"), c("quantity")))
    spread, mean = F.stddev_pop("gap"), F.avg("gap")
    out = t.groupBy("symbol", "edge").agg(
        F.when(rv > 0, F.greatest(F.lit(0.0), 1 - bv / rv)).alias("jump_ratio"),
        F.try_divide(spread - mean, spread + mean).alias("burstiness"),
        (F.count("*") / F.count(F.when(c("turn"), 1))).alias("toxicity_run_mean"),
        F.max("run").cast("long").alias("toxicity_run_max"),
        (F.max("run") / F.count("*")).alias("toxicity_ratio"),
        F.try_divide(F.sum(F.when(c("whale"), c("side") * c("quantity"))), whales).alias("whale_imbalance"),
        F.try_divide(F.sum(F.when(c("whale"), c("side") * c("step"))), whales).alias("whale_impact"),
    )
    return out.select("symbol", F.timestamp_millis("edge").alias("ts"), *FEATURES)


def with_vpin(panel: DataFrame, buckets: DataFrame, interval: str) -> DataFrame:
    """``panel`` (ts, symbol, ...) with ``vpin``, that of the last bucket that had ended with the
    row's interval; its rows stand for intervals from ``ts`` on."""
    ms = bars.interval_ms(interval)
    ended = F.col("end_time_ms") - F.pmod("end_time_ms", F.lit(ms))
    last = buckets.groupBy("symbol", F.timestamp_millis(ended).alias("ts")).agg(F.max_by("vpin", "bar_id").alias("__vpin"))
    return blocks.last_known(panel.join(last, ["symbol", "ts"], "left"), {"vpin": "__vpin"}).drop("__vpin")
