"""Cross-sectional analysis of factors: forward returns, bins, information
coefficients, quantile returns and turnover.

Everything carries ``factor`` as a key, so any number of factors is one job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling
from ..sources.stored import stored
from .panel import NUMBER, every_nth, finite, numbered

KEYS = ("factor", "ts", "symbol")


def forward_returns(prices: DataFrame, periods: list[int]) -> DataFrame:
    """(ts, symbol, ret_<p>...): p[t+n] / p[t] - 1 by the panel's timestamps, nothing
    filled; infinite or NaN from a price of 0."""
    full = numbered(prices.select("ts", "symbol", "close"))
    return full.select("ts", "symbol", *[(rolling.quotient(rolling.lag("close", -p, number=NUMBER), "close") - 1).alias(f"ret_{p}") for p in periods])


def equal_count_bin(x: str, by: list[str], bins: int) -> Column:
    """1 to ``bins``: edges are interpolated quantiles of the group, closed on the right."""
    edges = F.percentile(x, F.array(*[F.lit(i / bins) for i in range(1, bins)])).over(Window.partitionBy(*by))
    return 1 + F.size(F.filter(edges, lambda e: e < F.col(x)))


def equal_width_bin(x: str, by: list[str], bins: int) -> Column:
    """1 to ``bins`` of equal width between the group's extremes, closed on the right; with
    an infinite extreme, what has no place between them is in the last."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    share = F.try_divide((F.col(x) - low) * bins, high - low)
    place = F.when(F.isnan(share), bins).otherwise(F.ceil(share))
    return F.when(high > low, F.greatest(F.lit(1), F.least(F.lit(bins), place))).otherwise(F.lit((bins + 1) // 2)).cast("int")


def clean(factors: DataFrame, prices: DataFrame, *, periods: list[int], quantiles: int | None = 5, bins: int | None = None, max_loss: float | None = 0.5, rebalance: int = 1, infinite: bool = False) -> DataFrame:
    """(factor, ts, symbol, value, ret_<p>..., quantile): factor values that are
    finite and have every forward return, binned per factor and date. With
    ``max_loss``, losing a larger share of a factor's rows is an error (null: the
    share stays in column ``loss``). ``rebalance`` keeps every n-th timestamp.
    ``infinite`` keeps infinite and NaN values, too, NaN as the greatest."""
    if rebalance > 1:
        factors, prices = every_nth(factors, rebalance), every_nth(prices, rebalance)
    back = forward_returns(prices, periods)
    joined = factors.join(back, ["ts", "symbol"], "left")
    if not infinite:
        joined = joined.withColumn("value", finite("value"))
    sound = F.col("value").isNotNull()
    for p in periods:
        sound &= F.col(f"ret_{p}").isNotNull()
    loss = 1 - F.avg(sound.cast("double")).over(Window.partitionBy("factor"))
    if max_loss is None:
        joined = joined.withColumn("loss", loss)
    else:
        # Counting needs a key's rows together only as sums: a row per factor, joined back.
        lost = joined.groupBy("factor").agg((1 - F.avg(sound.cast("double"))).alias("__loss"))
        joined = joined.join(lost, "factor").filter(F.when(F.col("__loss") > max_loss, F.raise_error(F.concat(F.lit("too much of a factor is lost: "), "factor"))).otherwise(F.lit(True)).cast("boolean")).drop("__loss")
    kept = joined.filter(sound)
    binned = equal_width_bin("value", ["factor", "ts"], bins) if bins else equal_count_bin("value", ["factor", "ts"], quantiles)
    return kept.withColumn("quantile", binned.cast("int"))


def average_rank(x: str, by: list[str]) -> Column:
    """Rank in the group, ties sharing their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def rank_ic(data: DataFrame, periods: list[int], *, least: int = 3, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """(keys, ts, period, ic): Spearman correlation of value and forward return per date."""
    by = [*keys, "ts"]
    stacked = data.select(*by, "value", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(f"ret_{p}").alias("ret")) for p in periods])).alias("r")).select(*by, "value", "r.period", "r.ret").filter("ret is not null")
    by = [*by, "period"]
    ranked = stacked.withColumn("a", average_rank("value", by)).withColumn("b", average_rank("ret", by))
    spread = F.stddev_pop("a") * F.stddev_pop("b")
    return ranked.groupBy(*by).agg(F.when((F.count("*") >= least) & (spread > 0), F.try_divide(F.covar_pop("a", "b"), spread)).alias("ic"))


def ic_summary(ic: DataFrame) -> DataFrame:
    """(factor, period, mean_ic, icir, n)."""
    spread = F.stddev_samp("ic")
    return ic.groupBy("factor", "period").agg(F.avg("ic").alias("mean_ic"), F.when(spread > 0, F.avg("ic") / spread).alias("icir"), F.count("ic").alias("n"))


def cumulative_ic(ic: DataFrame) -> DataFrame:
    return ic.withColumn("cumulative_ic", F.sum("ic").over(Window.partitionBy("factor", "period").orderBy("ts")))


def rolling_ic(ic: DataFrame, n: int = 20) -> DataFrame:
    """The mean of the last n coefficients, once there are n (or all, if fewer)."""
    w = Window.partitionBy("factor", "period").orderBy("ts").rowsBetween(-(n - 1), 0)
    need = F.least(F.lit(n), F.count("*").over(Window.partitionBy("factor", "period")))
    return ic.withColumn("rolling_ic", F.when(F.count("*").over(w) >= need, F.avg("ic").over(w)))


def quantile_returns(data: DataFrame, periods: list[int]) -> DataFrame:
    """(factor, quantile, mean_<p>..., n), pooled over dates."""
    return data.groupBy("factor", "quantile").agg(*[F.avg(f"ret_{p}").alias(f"mean_{p}") for p in periods], F.count("*").alias("n"))


def quantile_spread(returns: DataFrame, periods: list[int]) -> DataFrame:
    """(factor, spread_<p>...): top less bottom quantile."""
    return returns.groupBy("factor").agg(*[(F.max_by(f"mean_{p}", "quantile") - F.min_by(f"mean_{p}", "quantile")).alias(f"spread_{p}") for p in periods])


def quantile_turnover(data: DataFrame, period: int = 1) -> DataFrame:
    """(factor, quantile, ts, turnover): share of names that weren't in the quantile
    ``period`` dates before; dates without such a date give none."""
    dates = data.select("factor", "ts").distinct().withColumn("k", F.row_number().over(Window.partitionBy("factor").orderBy("ts")))
    now = data.select(*KEYS, "quantile").join(dates, ["factor", "ts"])
    past = now.select("factor", "symbol", "quantile", (F.col("k") + period).alias("k"), F.lit(1).alias("there"))
    both = now.filter(F.col("k") > period).join(past, ["factor", "symbol", "quantile", "k"], "left")
    return both.groupBy("factor", "quantile", "ts").agg((1 - F.count("there") / F.count("*")).alias("turnover"))


@dataclass
class Analysis:
    """Results of ``analyze``, each a DataFrame."""

    data: DataFrame
    ic: DataFrame
    cumulative_ic: DataFrame
    summary: DataFrame
    quantile_returns: DataFrame
    spread: DataFrame
    turnover: DataFrame


def analyze(factors: DataFrame, prices: DataFrame, *, periods: list[int], **how) -> Analysis:
    """All of the above for all factors at once; the cleaned data are stored, as every result comes from them."""
    data = stored(clean(factors, prices, periods=periods, **how), "analysis-data")
    ic = rank_ic(data, periods)
    returns = quantile_returns(data, periods)
    return Analysis(data, ic, cumulative_ic(ic), ic_summary(ic), returns, quantile_spread(returns, periods), quantile_turnover(data, periods[0]))
