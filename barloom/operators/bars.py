"""Bars from ticks: by time, by tick count, by volume and by dollar volume.

Time bars are one groupBy. Threshold bars need each tick's running amount, but no
task goes through a symbol from end to end: days are folded per symbol on their
sums alone (a row per day), which gives every day the amount carried into it and
the bars before it; ticks then need a running sum within (symbol, day) only. A
tick that crosses thresholds is split over the bars it touches.

Amounts are decimals, so that both running sums see the same values and a bar
closes at exactly its threshold.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AMOUNT = "decimal(28,8)"
#: Thresholds, and numbers of bars in a day, so that their products keep all digits.
THRESHOLD, COUNT = "decimal(19,8)", "decimal(18,0)"
#: Running sums: so short of 38 digits that sums and differences keep all digits, too.
RUNNING = "decimal(30,8)"
#: Amounts that a day's total is made of.
TOTAL = "decimal(38,14)"
DAY_MS = 86_400_000
_UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "min": 60_000, "h": 3_600_000, "d": DAY_MS, "w": 7 * DAY_MS}


def interval_ms(text: str) -> int:
    """Milliseconds of 500ms, 30s, 5min or 5m, 4h, 1d, 1w; anything else is an error."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|min|[smhdw])\s*", text)
    if not m or not int(m[1]):
        raise ValueError(f"no interval: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return _zero(F.try_divide(a, b))


def with_steps(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Adds what each piece has against the one before it in its bar: price step,
    direction, reversal against the last direction that isn't 0, gap in ms."""
    w = Window.partitionBy(*keys).orderBy("ts", "trade_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    step = pieces.withColumn("step", F.col("price") - F.lag("price").over(w)).withColumn("gap", F.col("ms") - F.lag("ms").over(w)).withColumn("way", F.signum("step"))
    last_way = F.last(F.when(F.col("way") != 0, F.col("way")), ignorenulls=True).over(before)
    return step.withColumn("turn", (F.col("way") != 0) & (F.col("way") != last_way))


BASIC = ("start_time_ms", "end_time_ms", "open", "high", "low", "close", "volume", "buy_volume", "sell_volume", "vwap", "tick_count", "dollar_volume")
ADVANCED = ("price_std", "volume_std", "up_move_ratio", "down_move_ratio", "reversals", "buy_sell_imbalance", "spread_proxy", "skewness", "kurtosis", "max_trade_volume", "max_trade_ratio", "tick_interval_mean", "tick_interval_std", "path_efficiency", "impact_density")


def aggregate(pieces: DataFrame, keys: list[str], *, advanced: bool = True, extra: list[Column] = ()) -> DataFrame:
    """One row per key: the basic columns and, if wanted, the advanced ones.
    ``pieces``: price, quantity, notional, is_buyer_maker, ts, ms, trade_id."""
    n, q, amount = F.count("*"), F.sum("quantity"), F.sum("notional")
    order = F.struct("ts", "trade_id")
    basic = [
        F.min("ms").alias("start_time_ms"),
        F.max("ms").alias("end_time_ms"),
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        q.alias("volume"),
        F.sum(F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0.0)).alias("buy_volume"),
        amount.alias("dollar_volume"),
        n.alias("tick_count"),
    ]
    more = [
        _zero(F.stddev_samp("price")).alias("price_std"),
        _zero(F.stddev_samp("quantity")).alias("volume_std"),
        (F.sum(F.when(F.col("step") > 0, 1).otherwise(0)) / n).alias("up_move_ratio"),
        (F.sum(F.when(F.col("step") < 0, 1).otherwise(0)) / n).alias("down_move_ratio"),
        F.sum(F.coalesce(F.col("turn"), F.lit(False)).cast("long")).alias("reversals"),
        F.when((n >= 3) & (F.max("price") > F.min("price")), F.skewness("price")).otherwise(0.0).alias("skewness"),
        F.when((n >= 4) & (F.max("price") > F.min("price")), F.kurtosis("price")).otherwise(0.0).alias("kurtosis"),
        F.greatest(F.max("quantity"), F.lit(0.0)).alias("max_trade_volume"),
        _zero(F.avg(F.when(F.col("gap") >= 0, F.col("gap")))).alias("tick_interval_mean"),
        _zero(F.stddev_samp(F.when(F.col("gap") >= 0, F.col("gap")))).alias("tick_interval_std"),
        _zero(F.sum(F.abs("step"))).alias("path"),
    ]
    bar = (with_steps(pieces, keys) if advanced else pieces).groupBy(*keys).agg(*basic, *(more if advanced else []), *extra)
    c = F.col
    bar = bar.withColumns({"sell_volume": c("volume") - c("buy_volume"), "vwap": _ratio(c("dollar_volume"), c("volume"))})
    if advanced:
        bar = bar.withColumns(
            {
                "buy_sell_imbalance": _ratio(c("buy_volume") - c("sell_volume"), c("volume")),
                "spread_proxy": F.when((c("vwap") > 0) & (c("high") > c("low")), (c("high") - c("low")) / c("vwap")).otherwise(0.0),
                "max_trade_ratio": _ratio(c("max_trade_volume"), c("volume")),
                "path_efficiency": F.when(c("path") > 0, F.abs(c("close") - c("open")) / c("path")).otherwise(1.0),
                "impact_density": _ratio(F.abs(c("close") - c("open")), c("dollar_volume")),
            }
        )
    return bar


def _timed(trades: DataFrame) -> DataFrame:
    return trades.withColumn("ms", F.unix_millis("ts")).withColumn("notional", F.col("price") * F.col("quantity"))


def time_bars(trades: DataFrame, interval: str, *, advanced: bool = True) -> DataFrame:
    """Bars of fixed length, aligned to the epoch (weeks thus begin on Thursdays);
    empty ones are left out. start_time_ms is the bar's edge, end_time_ms its last
    tick. ``month`` is that of the tick that closed the bar, the next bar's first;
    the last bar of a symbol is incomplete and filed under its own month."""
    step = interval_ms(interval)
    edge = F.col("ms") - F.pmod("ms", F.lit(step))
    bar = aggregate(_timed(trades).withColumn("edge", edge), ["symbol", "edge"], advanced=advanced)
    closing = F.lead("first_ms").over(Window.partitionBy("symbol").orderBy("edge"))
    bar = bar.withColumn("first_ms", F.col("start_time_ms")).withColumn("closing", closing)
    bar = bar.withColumns({"start_time_ms": F.col("edge"), "is_complete": F.col("closing").isNotNull(), "month": F.date_format(F.timestamp_millis(F.coalesce("closing", "end_time_ms")), "yyyy-MM")})
    bar = bar.withColumn("bar_id", F.expr(f"edge div {step}"))
    return bar.select("symbol", "bar_id", *BASIC, *(ADVANCED if advanced else ()), "is_complete", "month")


def quote_bars(quotes: DataFrame, interval: str) -> DataFrame:
    """Time bars of the mid price and the spread; spread_max is 0 at least."""
    step = interval_ms(interval)
    q = quotes.withColumn("ms", F.unix_millis("ts")).withColumn("mid", (F.col("best_bid_price") + F.col("best_ask_price")) / 2).withColumn("spread", F.col("best_ask_price") - F.col("best_bid_price"))
    order = F.struct(*[c for c in ("ts", "quote_id", "mid", "spread") if c in q.columns])
    bar = q.groupBy("symbol", (F.col("ms") - F.pmod("ms", F.lit(step))).alias("start_time_ms")).agg(
        F.max("ms").alias("end_time_ms"),
        F.min_by("mid", order).alias("open"),
        F.max("mid").alias("high"),
        F.min("mid").alias("low"),
        F.max_by("mid", order).alias("close"),
        F.count("*").alias("tick_count"),
        F.avg("spread").alias("spread_mean"),
        _zero(F.stddev_samp("spread")).alias("spread_std"),
        F.greatest(F.max("spread"), F.lit(0.0)).alias("spread_max"),
    )
    return bar.withColumns({f"mid_{x}": F.col(x) for x in ("open", "high", "low", "close")})


def _epoch_day(ms: str = "ms") -> Column:
    return F.floor(F.col(ms) / DAY_MS)


def daily_profile(trades: DataFrame, amount: str = "dollar") -> DataFrame:
    """(symbol, day, total): the summed dollar volume, or volume, per epoch day. Sums are
    of decimals, so that the order of ticks doesn't move a threshold made of them."""
    t = _timed(trades)
    exact = F.col("notional" if amount == "dollar" else "quantity").cast(TOTAL)
    return t.groupBy("symbol", _epoch_day().alias("day")).agg(F.sum(exact).cast("double").alias("total"))


def daily_thresholds(profile: DataFrame, *, lookback: int = 10, bars_per_day: int = 50, discard_months: int = 1) -> DataFrame:
    """(symbol, day, threshold): the mean of the ``lookback`` days with data before,
    over ``bars_per_day``; none for the first 30 * ``discard_months`` days."""
    if lookback <= 0 or bars_per_day <= 0 or discard_months < 0:
        raise ValueError("lookback and bars_per_day must be positive, discard_months not negative")
    w = Window.partitionBy("symbol").orderBy("day")
    first = F.min("day").over(Window.partitionBy("symbol"))
    mean = F.avg("total").over(w.rowsBetween(-lookback, -1))
    found = profile.select("symbol", "day", (mean / bars_per_day).alias("threshold"), first.alias("first"))
    return found.filter((F.col("day") > F.col("first") + 30 * discard_months) & (F.col("threshold") > 0)).select("symbol", "day", "threshold")


def tick_bars(trades: DataFrame, n: int, *, advanced: bool = True) -> DataFrame:
    """Bars of ``n`` trades, numbered by per-day counts, so that no task counts a whole symbol."""
    t = _timed(trades).withColumn("day", _epoch_day())
    days = t.groupBy("symbol", "day").agg(F.count("*").alias("n"))
    before = days.withColumn("before", F.sum("n").over(Window.partitionBy("symbol").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("symbol", "day").orderBy("ts", "trade_id")) - 1
    pieces = t.withColumn("rank", rank).join(before, ["symbol", "day"]).withColumn("bar_id", F.expr(f"(rank + before) div {n}"))
    bar = aggregate(pieces, ["symbol", "bar_id"], advanced=advanced)
    return bar.withColumn("is_complete", F.col("tick_count") == n).select("symbol", "bar_id", *BASIC, *(ADVANCED if advanced else ()), "is_complete")


def _fold(days: DataFrame) -> DataFrame:
    """``days`` (symbol, day, total, thr) with the amount carried into each day and the bars before it."""
    start = F.struct(F.lit(0).cast(AMOUNT).alias("carry"), F.lit(0).cast("long").alias("bars"), F.array().cast(f"array<struct<day: bigint, carry: {AMOUNT}, bars: bigint, thr: {THRESHOLD}>>").alias("out"))

    def step(s: Column, d: Column) -> Column:
        held = (s.carry + d.total).cast(RUNNING)
        # Quotient and remainder of decimals are exact, products of such digits aren't.
        full = F.call_function("div", held, d.thr)
        return F.struct((held % d.thr).cast(AMOUNT).alias("carry"), (s.bars + full).alias("bars"), F.concat(s.out, F.array(F.struct(d.day.alias("day"), s.carry.alias("carry"), s.bars.alias("bars"), d.thr.alias("thr")))).alias("out"))

    listed = days.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("day", "total", "thr"))).alias("days"))
    return listed.select("symbol", F.inline(F.aggregate("days", start, step).out))


def _amount(trades: DataFrame, amount: str) -> DataFrame:
    """Ticks with notional, with their day and exact amount; ``exact``, if the trades have
    it, is the amount of what an earlier run carried over."""
    t = _timed(trades).filter(F.col("notional") > 0).withColumn("day", _epoch_day())
    own = (F.round("notional", 6) if amount == "dollar" else F.col("quantity")).cast(AMOUNT)
    return t.withColumn("amount", F.coalesce("exact", own) if "exact" in t.columns else own)


def threshold_bars(trades: DataFrame, amount: str, threshold: float | DataFrame, *, before_first: str = "first", advanced: bool = True, most_pieces: int = 100_000, opened: DataFrame | None = None, resumable: bool = False) -> DataFrame:
    """Volume (``amount='volume'``) or dollar (``'dollar'``) bars.

    ``threshold``: a number, or (symbol, day, threshold) rows, of which each day
    takes the latest up to it; days before the first take the first, or with
    ``before_first='drop'`` are left out. A bar that is open when the threshold
    changes goes on with the new one. Ticks without notional are skipped. A bar
    after the first starts at the time of the tick that closed the one before.
    A tick that would span over ``most_pieces`` bars is an error.

    ``opened`` (symbol, bars, begin_ms) goes on from an earlier run: bars are numbered
    from ``bars``, and the first begins at ``begin_ms``. ``resumable`` adds ``first``, the
    piece each bar begins with; see ``operators.resume``.
    """
    t = _amount(trades, amount)
    days = t.groupBy("symbol", "day").agg(F.sum("amount").cast(AMOUNT).alias("total"))
    if isinstance(threshold, DataFrame):
        w = Window.partitionBy("symbol").orderBy("day")
        known = threshold.select("symbol", "day", F.col("threshold").cast(THRESHOLD).alias("thr"))
        joined = days.join(known, ["symbol", "day"], "full").withColumn("thr", F.last("thr", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        first = F.first("thr", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        if before_first == "first":
            joined = joined.withColumn("thr", F.coalesce("thr", first))
        days = joined.filter("total is not null")
        # A symbol without any threshold can't be cut into bars.
        days = days.withColumn("thr", F.when(F.col("thr").isNull() & first.isNull(), F.raise_error(F.lit("no threshold: too little history"))).otherwise(F.col("thr"))).filter("thr is not null")
    else:
        if threshold <= 0:
            raise ValueError("a threshold must be positive")
        days = days.withColumn("thr", F.lit(str(threshold)).cast(THRESHOLD))

    w = Window.partitionBy("symbol", "day").orderBy("ts", "trade_id")
    run = t.join(_fold(days), ["symbol", "day"]).withColumn("hi", (F.col("carry") + F.sum("amount").over(w).cast(AMOUNT)).cast(RUNNING)).withColumn("rn", F.row_number().over(w))
    run = run.withColumn("lo", (F.col("hi") - F.col("amount")).cast(RUNNING))
    run = run.withColumn("k0", F.expr("case when rn = 1 then 0 else lo div thr end")).withColumn("k1", F.greatest("k0", F.expr("hi div thr - cast(hi % thr = 0 as int)")))
    run = run.withColumn("k", F.explode(F.when(F.col("k1") - F.col("k0") > most_pieces, F.raise_error(F.lit("a tick spans too many bars: the threshold is too small"))).otherwise(F.sequence("k0", "k1"))))
    run = run.withColumns({"from": (F.col("k").cast(COUNT) * F.col("thr")).cast(RUNNING), "upto": ((F.col("k") + 1).cast(COUNT) * F.col("thr")).cast(RUNNING)})
    exact = F.expr("least(hi, upto) - case when k = k0 then lo else from end").cast(AMOUNT)
    pieces = run.withColumn("exact", exact).withColumn("part", F.col("exact").cast("double")).withColumn("bar_id", F.col("bars") + F.col("k"))
    if amount == "dollar":
        pieces = pieces.withColumns({"notional": F.col("part"), "quantity": F.col("part") / F.col("price")})
    else:
        pieces = pieces.withColumns({"quantity": F.col("part"), "notional": F.col("part") * F.col("price")})
    extra = [F.max(F.col("hi") >= F.col("upto")).alias("is_complete")]
    if resumable:
        extra.append(F.min_by(F.struct("ts", "trade_id", "price", "quantity", "is_buyer_maker", "exact"), F.struct("ts", "trade_id")).alias("first"))
    bar = aggregate(pieces, ["symbol", "bar_id"], advanced=advanced, extra=extra)
    start = F.lag("end_time_ms").over(Window.partitionBy("symbol").orderBy("bar_id"))
    if opened is not None:
        # A row per symbol.
        bar = bar.join(opened.select("symbol", "bars", "begin_ms"), "symbol", "left").withColumn("start_time_ms", F.coalesce(start, "begin_ms", "start_time_ms")).withColumn("bar_id", F.col("bar_id") + F.coalesce("bars", F.lit(0)))
    else:
        bar = bar.withColumn("start_time_ms", F.coalesce(start, "start_time_ms"))
    return bar.select("symbol", "bar_id", *BASIC, *(ADVANCED if advanced else ()), "is_complete", *(["first"] if resumable else []))


def adaptive_bars(trades: DataFrame, amount: str, threshold: float | DataFrame | str, *, lookback: int = 10, bars_per_day: int = 50, discard_months: int = 1, **how) -> DataFrame:
    """Threshold bars, ``'auto'`` being the threshold of each day's own past."""
    if isinstance(threshold, str):
        if threshold != "auto":
            raise ValueError(f"no threshold: {threshold!r}")
        threshold = daily_thresholds(daily_profile(trades, amount), lookback=lookback, bars_per_day=bars_per_day, discard_months=discard_months)
    return threshold_bars(trades, amount, threshold, **how)


def volume_bars(trades: DataFrame, threshold: float | DataFrame | str, **how) -> DataFrame:
    """Volume bars with a fixed, given or automatic threshold."""
    return adaptive_bars(trades, "volume", threshold, **how)


def dollar_bars(trades: DataFrame, threshold: float | DataFrame | str = "auto", **how) -> DataFrame:
    """Dollar bars with a fixed, given or automatic threshold."""
    return adaptive_bars(trades, "dollar", threshold, **how)
