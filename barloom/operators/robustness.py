"""How much a factor's figures hang on the sample: replicates without some dates, without
some symbols, traded with a delay; and what its orders cost at a given capital.

Replicates are a key beside the factor, so any number of them is one job. Whether a
replicate has a date or a symbol is a digest of both, which needs no list. Dates go after
the coefficients are there, so a replicate without dates costs a row per date; one without
symbols ranks anew and costs its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rolling
from . import analysis, backtest

KEYS = ("factor", "kind", "replicate")
#: How a date is written where its digest decides.
DATE = "yyyy-MM-dd HH:mm:ss"


def limit(share: float) -> str:
    """The least first eight hexadecimal digits of a digest that keeps what ``share`` is dropped of."""
    return f"{min(16**8 - 1, int(share * 16**8)):08x}"


def _kept(what: str, text: Column, r: Column, drop: float, seed: int) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(what), r.cast("string"), text)), 1, 8) >= limit(drop)


def _each(kept, replicates: int) -> Column:
    """A row for each replicate that keeps it."""
    return F.explode(F.filter(F.sequence(F.lit(1), F.lit(replicates)), kept))


def delayed(data: DataFrame, delays: tuple[int, ...], period: int) -> DataFrame:
    """Values and quantiles of ``data`` with the returns of so many of the factor's dates later;
    ``replicate`` is the delay. What has no row on the later date goes."""
    numbers = data.select("factor", "ts").distinct().withColumn("k", F.row_number().over(Window.partitionBy("factor").orderBy("ts")))
    rows = data.join(numbers, ["factor", "ts"])
    late = rows.select("factor", "symbol", "value", "quantile", F.explode(F.array(*[F.lit(d) for d in delays])).alias("replicate"), "k").withColumn("k", F.col("k") + F.col("replicate"))
    return late.join(rows.select("factor", "symbol", "k", "ts", f"ret_{period}"), ["factor", "symbol", "k"]).drop("k")


def replicates(data: DataFrame, *, n: int = 20, drop_dates: float = 0.2, drop_symbols: float = 0.3, delays: tuple[int, ...] = (1, 2), period: int = 1, seed: int = 0) -> DataFrame:
    """(factor, kind, replicate, n_dates, mean_ic, icir, spread) of cleaned ``data``
    (analysis.clean): kind ``base`` (replicate 0), ``dates`` and ``symbols`` (1 to ``n``),
    ``delay`` (the delay). ``spread`` is the mean over dates of the highest less the lowest
    quantile's mean return; bins stay those of all symbols. ``n_dates`` counts dates with a
    coefficient. An empty table gives no rows, a null symbol is none."""
    columns = ["factor", "kind", "replicate", "ts", "value", "quantile", f"ret_{period}"]
    rows = data.filter("symbol is not null")
    base = rows.withColumns({"kind": F.lit("base"), "replicate": F.lit(0)})
    fewer = rows.withColumns({"kind": F.lit("symbols"), "replicate": _each(lambda r: _kept("symbols", F.col("symbol").cast("string"), r, drop_symbols, seed), n)})
    late = delayed(rows, delays, period).withColumn("kind", F.lit("delay"))
    made = base.select(columns).unionByName(fewer.select(columns)).unionByName(late.select(columns))
    ic = analysis.rank_ic(made, [period], keys=KEYS).drop("period")
    ends = rows.groupBy("factor").agg(F.max("quantile").alias("__top"))
    leg = lambda q: F.avg(F.when(F.col("quantile") == q, F.col(f"ret_{period}")))
    legs = made.join(ends, "factor").groupBy(*KEYS, "ts").agg((leg(F.col("__top")) - leg(F.lit(1))).alias("spread"))
    dated = ic.join(legs, [*KEYS, "ts"])
    without = dated.filter("kind = 'base'").withColumns({"kind": F.lit("dates"), "replicate": _each(lambda r: _kept("dates", F.date_format("ts", DATE), r, drop_dates, seed), n)})
    spread = F.stddev_samp("ic")
    return dated.unionByName(without).groupBy(*KEYS).agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("mean_ic"), F.when(spread > 0, F.avg("ic") / spread).alias("icir"), F.avg("spread").alias("spread"))


def stability(found: DataFrame) -> DataFrame:
    """(factor, kind, n, base_ic, mean_ic, low_ic, high_ic, std_ic, same_sign) over the
    replicates of each kind; ``same_sign`` is the share whose coefficient has the base's sign."""
    base = found.filter("kind = 'base'").select("factor", F.col("mean_ic").alias("base_ic"))
    both = found.filter("kind <> 'base'").join(base, "factor")
    x = F.col("mean_ic")
    return both.groupBy("factor", "kind", "base_ic").agg(F.count("*").alias("n"), F.avg(x).alias("mean_ic"), F.min(x).alias("low_ic"), F.max(x).alias("high_ic"), F.stddev_samp(x).alias("std_ic"), F.avg((F.signum(x) == F.signum("base_ic")).cast("double")).alias("same_sign"))


def capacity(weights: DataFrame, volumes: DataFrame, capitals: list[float], *, impact: float = 0.1, n: int = 20, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """(keys, capital, n_orders, n_unpriced, participation, most, turnover, cost) of target
    ``weights`` (keys, ts, symbol, weight), which add up where a symbol comes twice.

    Orders are the changes of weights between the key's dates, the first date's from
    nothing. ``volumes`` (ts, symbol, dollar_volume) give the mean of a symbol's last ``n``
    rows; an order takes ``participation`` of it (mean and most over orders) and slips by
    ``impact`` times the square root of that. ``turnover`` and ``cost`` are means over dates
    of the changes and of the slippage, in parts of the capital. Orders without a volume
    are counted and cost nothing."""
    k = list(keys)
    dates = backtest._dates(weights, keys).drop("next_ts")
    held = weights.join(dates, [*k, "ts"]).select(*k, "symbol", F.explode(F.array(F.struct("k", "weight"), F.struct((F.col("k") + 1).alias("k"), (-F.col("weight")).alias("weight")))).alias("m"))
    orders = held.select(*k, "symbol", "m.*").groupBy(*k, "symbol", "k").agg(F.sum("weight").alias("change")).filter(F.abs("change") > 1e-12).join(dates, [*k, "k"])
    usual = volumes.select("ts", "symbol", rolling.mean("dollar_volume", n).alias("usual"))
    sized = orders.join(usual, ["ts", "symbol"], "left").withColumn("capital", F.explode(F.array(*[F.lit(float(x)) for x in capitals])))
    sized = sized.withColumn("part", F.when(F.col("usual") > 0, F.abs("change") * F.col("capital") / F.col("usual")))
    each = sized.groupBy(*k, "capital").agg(F.count("*").alias("n_orders"), F.count(F.when(F.col("part").isNull(), 1)).alias("n_unpriced"), F.avg("part").alias("participation"), F.max("part").alias("most"), F.sum(F.abs("change")).alias("__turned"), F.sum(F.abs("change") * F.sqrt("part") * impact).alias("__cost"))
    days = dates.groupBy(*k).agg(F.count("*").alias("__days"))
    per_day = lambda x: F.coalesce(F.col(x), F.lit(0.0)) / F.col("__days")
    return each.join(days, k).select(*k, "capital", "n_orders", "n_unpriced", "participation", "most", per_day("__turned").alias("turnover"), per_day("__cost").alias("cost"))
