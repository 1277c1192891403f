"""Long-short backtests on sets: weights, turnover, returns, value and metrics.

No loop over dates: weights hang on the date's quantiles alone, turnover on two
adjacent dates, the portfolio's value is a running product. Every table carries
``keys`` (by default factor), so any number of portfolios is one job; what is
ordered by date within a key has a row per date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("factor",)


def leg_weights(data: DataFrame, *, long_quantile: int | None = None, short_quantile: int | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts, symbol, leg, weight): +1 over the number of longs, -1 over that of
    shorts; the long leg is the highest quantile of all dates, unless given, the
    short leg 1. A symbol in both legs has a row in each."""
    top = data.groupBy(*keys).agg((F.lit(long_quantile) if long_quantile else F.max("quantile")).alias("__long"))
    seen = data.join(top, list(keys))
    legs = F.array(F.when(F.col("quantile") == F.col("__long"), F.lit("long")), F.when(F.col("quantile") == (short_quantile or 1), F.lit("short")))
    rows = seen.select(*keys, "ts", "symbol", F.explode(F.array_compact(legs)).alias("leg"))
    n = F.count("*").over(Window.partitionBy(*keys, "ts", "leg"))
    return rows.withColumn("weight", F.when(F.col("leg") == "long", 1.0).otherwise(-1.0) / n)


def _dates(data: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ts")
    return data.select(*keys, "ts").distinct().withColumn("k", F.row_number().over(w)).withColumn("next_ts", F.lead("ts").over(w))


def _per_date(held: DataFrame, prices: DataFrame, dates: DataFrame, keys: tuple[str, ...], **figures: Column) -> DataFrame:
    """(keys, k, turnover, figures) from ``held`` (keys, ts, symbol, weight, ...), a row per
    symbol: one pass over the positions. A row tells its date what it changed against the
    date before, and the next date, if the symbol isn't held there, what was sold.
    ``figures`` aggregate over ``weight``, ``r``, the return until the next date where
    both prices are there, and held's other columns; rows of what was sold have nulls there."""
    p0 = prices.select("ts", "symbol", F.col("close").alias("p0"))
    p1 = prices.select(F.col("ts").alias("next_ts"), "symbol", F.col("close").alias("p1"))
    rows = held.join(dates, [*keys, "ts"]).join(p0, ["ts", "symbol"], "left").join(p1, ["next_ts", "symbol"], "left").withColumn("r", F.try_divide("p1", "p0") - 1)
    w = Window.partitionBy(*keys, "symbol").orderBy("k")
    before = F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag("weight").over(w)).otherwise(0.0)
    stays = F.coalesce(F.lead("k").over(w) == F.col("k") + 1, F.lit(False))
    rows = rows.withColumns({"__before": before, "__stays": stays})
    other = [c for c in held.columns if c not in (*keys, "ts", "symbol", "weight")]
    own = F.struct(F.col("k").alias("k"), F.abs(F.col("weight") - F.col("__before")).alias("change"), "weight", "r", *other)
    kinds = dict(held.dtypes)
    sold = F.struct((F.col("k") + 1).alias("k"), F.abs("weight").alias("change"), *[F.lit(None).cast(t).alias(c) for c, t in (("weight", "double"), ("r", "double"), *((c, kinds[c]) for c in other))])
    moves = rows.select(*keys, F.explode(F.when(F.col("__stays"), F.array(own)).otherwise(F.array(own, sold))).alias("m")).select(*keys, "m.*")
    return moves.groupBy(*keys, "k").agg(F.sum("change").alias("turnover"), *[f.alias(n) for n, f in figures.items()])


def _period_rows(dates: DataFrame, found: DataFrame, bps: float, keys: tuple[str, ...]) -> DataFrame:
    """A row for each date that has a next one; a date on which nothing is held earns and costs nothing."""
    figures = [c for c in found.columns if c not in (*keys, "k")]
    # Not fillna, which would take a NaN, the return of undefined weights, for nothing earned.
    rows = dates.filter("next_ts is not null").join(found, [*keys, "k"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in figures})
    gross = F.col("gross") if "gross" in figures else F.col("long_return") - F.col("short_return")
    rows = rows.withColumn("gross", gross).withColumn("cost", F.col("turnover") * bps / 10_000)
    return rows.withColumn("net", F.col("gross") - F.col("cost"))


def long_short(data: DataFrame, prices: DataFrame, *, cost_bps: float = 0.0, long_quantile: int | None = None, short_quantile: int | None = None, signal_lag: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, ts, next_ts, k, long_return, short_return, gross, turnover, cost, net): a
    row for each of the N - 1 periods between N dates. Turnover sums the changes of
    target weights since the date before, the first date's from nothing; a leg's return
    is the mean over its symbols that have both prices, 0 without any. ``signal_lag``
    trades on the quantiles of so many dates before."""
    dates = _dates(data, keys)
    if signal_lag:
        moved = dates.select(*keys, (F.col("k") - signal_lag).alias("k"), F.col("ts").alias("moved"))
        data = data.join(dates.drop("next_ts").join(moved, [*keys, "k"]), [*keys, "ts"]).withColumn("ts", F.col("moved")).drop("k", "moved")
    top = F.lit(long_quantile) if long_quantile else F.col("__long")
    seen = data.select(*keys, "ts", "symbol", "quantile")
    if not long_quantile:
        seen = seen.join(data.groupBy(*keys).agg(F.max("quantile").alias("__long")), list(keys))
    legs = seen.withColumns({"long": F.col("quantile") == top, "short": F.col("quantile") == (short_quantile or 1)}).filter("long or short")
    date = Window.partitionBy(*keys, "ts")
    share = lambda leg: F.when(F.col(leg), 1 / F.count(F.when(F.col(leg), 1)).over(date)).otherwise(0.0)
    held = legs.select(*keys, "ts", "symbol", "long", "short", (share("long") - share("short")).alias("weight"))
    mean = lambda leg: F.avg(F.when(F.col(leg), F.col("r")))
    rows = _period_rows(dates, _per_date(held, prices, dates, keys, long_return=mean("long"), short_return=mean("short")), cost_bps, keys)
    return rows.select(*keys, "ts", "next_ts", "k", "long_return", "short_return", "gross", "turnover", "cost", "net")


def from_weights(weights: DataFrame, prices: DataFrame, *, cost_bps: float = 0.0, keys: tuple[str, ...] = KEYS, dates: DataFrame | None = None) -> DataFrame:
    """The same periods for given target weights (keys, ts, symbol, weight), which add up
    where a symbol comes twice; ``dates`` (keys, ts) adds dates on which nothing is held."""
    days = _dates(dates if dates is not None else weights, keys)
    net = weights.groupBy(*keys, "ts", "symbol").agg(F.sum("weight").alias("weight"))
    found = _per_date(net, prices, days, keys, gross=F.sum(F.col("weight") * F.col("r")))
    return _period_rows(days, found, cost_bps, keys).select(*keys, "ts", "next_ts", "k", "gross", "turnover", "cost", "net")


def nav(periods: DataFrame, keys: tuple[str, ...] = KEYS, dates: DataFrame | None = None) -> DataFrame:
    """(keys, ts, nav): 1 on the first date, then the running product of 1 + net.
    A portfolio of a single date (from ``dates``) has that first row alone."""
    w = Window.partitionBy(*keys).orderBy("ts")
    run = periods.withColumns({"__nav": F.product(1 + F.col("net")).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__place": F.row_number().over(w)})
    value = F.struct(F.col("next_ts").alias("ts"), F.col("__nav").alias("nav"))
    if dates is not None:
        begin = dates.groupBy(*keys).agg(F.min("ts").alias("ts")).withColumn("nav", F.lit(1.0))
        return begin.unionByName(run.select(*keys, value.alias("v")).select(*keys, "v.*"))
    begin = F.struct("ts", F.lit(1.0).alias("nav"))
    return run.select(*keys, F.explode(F.when(F.col("__place") == 1, F.array(begin, value)).otherwise(F.array(value))).alias("v")).select(*keys, "v.*")


def drawdown(values: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    high = F.max("nav").over(Window.partitionBy(*keys).orderBy("ts"))
    return values.withColumn("drawdown", F.col("nav") / high - 1)


def performance(values: DataFrame, keys: tuple[str, ...] = KEYS, *, periods_per_year: int = 252, risk_free: float = 0.0) -> DataFrame:
    """Per key: total_return, annual_return, volatility, sharpe, sortino, max_drawdown,
    calmar. Values are taken at the end of each day; ratios are 0 with fewer than
    two daily returns, all with fewer than two values. The drawdown is that of the
    daily returns' product, which doesn't begin at 1."""
    k = list(keys)
    day = values.groupBy(*k, F.to_date("ts").alias("day")).agg(F.max_by("nav", "ts").alias("nav"), F.min_by("nav", "ts").alias("first"), F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count("*").alias("n"))
    w = Window.partitionBy(*k).orderBy("day")
    r = day.withColumn("r", F.try_divide("nav", F.lag("nav").over(w)) - 1).withColumn("x", F.col("r") - risk_free / periods_per_year)
    # Days without a return take no part in the product, whose drawdown thus begins with the first return.
    run = r.withColumn("p", F.when(F.col("r").isNotNull(), F.product(1 + F.col("r")).over(w))).withColumn("dd", F.col("p") / F.max("p").over(w) - 1)
    year = F.sqrt(F.lit(float(periods_per_year)))
    bad = F.stddev_pop(F.when(F.col("x") < 0, F.col("x")))
    out = run.groupBy(*k).agg(
        F.sum("n").alias("n"),
        F.min_by("first", "day").alias("v0"),
        F.max_by("nav", "day").alias("v1"),
        ((F.unix_micros(F.max("end")) - F.unix_micros(F.min("begin"))) / 1e6 / (365.25 * 86_400)).alias("years"),
        F.count("r").alias("days"),
        (F.stddev_pop("r") * year).alias("volatility"),
        F.when(F.stddev_pop("x") > 0, F.avg("x") / F.stddev_pop("x") * year).alias("sharpe"),
        F.when(bad > 0, F.avg("x") / bad * year).alias("sortino"),
        F.min("dd").alias("max_drawdown"),
    )
    total = F.when(F.col("n") >= 2, F.col("v1") / F.col("v0") - 1).otherwise(0.0)
    out = out.withColumn("total_return", total)
    out = out.withColumn("annual_return", F.when((F.col("years") > 0) & (F.col("total_return") > -1), F.pow(1 + F.col("total_return"), 1 / F.col("years")) - 1).otherwise(0.0))
    some = F.coalesce(F.col("days") >= 2, F.lit(False))
    ratio = lambda c: F.when(some, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    out = out.withColumns({c: ratio(F.col(c)) for c in ("volatility", "sharpe", "sortino", "max_drawdown")})
    return out.withColumn("calmar", F.coalesce(F.try_divide("annual_return", F.abs("max_drawdown")), F.lit(0.0))).select(*k, "total_return", "annual_return", "volatility", "sharpe", "sortino", "max_drawdown", "calmar")


def trading(periods: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per key: total_cost, avg_turnover, n_rebalances."""
    return periods.groupBy(*keys).agg(F.sum("cost").alias("total_cost"), F.avg("turnover").alias("avg_turnover"), F.count("*").alias("n_rebalances"))


def summary(ic: DataFrame, spread: DataFrame, perf: DataFrame, traded: DataFrame, *, period: int) -> DataFrame:
    """A row per factor: coefficients to 4 places, spread to 6, the backtest's
    figures; the largest absolute ICIR first."""
    one = ic.filter(F.col("period") == period).select("factor", F.round("mean_ic", 4).alias("mean_ic"), F.round("icir", 4).alias("icir"))
    bt = perf.select("factor", *[F.col(c).alias(f"bt_{c}") for c in ("total_return", "annual_return", "sharpe", "max_drawdown")]).join(traded.select("factor", F.col("avg_turnover").alias("bt_avg_turnover"), F.col("n_rebalances").alias("bt_n_rebalances")), "factor")
    return one.join(spread.select("factor", F.round(f"spread_{period}", 6).alias("spread")), "factor", "left").join(bt, "factor", "left").orderBy(F.abs("icir").desc_nulls_last(), "factor")


def holding_return(prices: DataFrame, start: str, end: str, symbols: list[str]) -> float:
    """The mean return of the symbols that have both prices; 0 without any."""
    at = lambda t, n: prices.filter((F.col("ts") == F.lit(t).cast("timestamp")) & F.col("symbol").isin(symbols) & F.col("close").isNotNull()).select("symbol", F.col("close").alias(n))
    return at(start, "p0").join(at(end, "p1"), "symbol").agg(F.coalesce(F.avg(F.try_divide("p1", "p0") - 1), F.lit(0.0))).first()[0]
