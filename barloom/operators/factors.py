"""Factors on a panel: raw columns, rolling methods, and custom Columns.

All factors of a call are computed in one select over a panel whose timestamps are
numbered, so symbols are shuffled once; the result is long: (factor, ts, symbol, value).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rolling
from .panel import NUMBER, numbered

METHODS = ("zscore", "mean", "std", "change", "diff", "rank")


@dataclass(frozen=True)
class Factor:
    """``kind`` raw: ``column`` itself; rolling: ``method`` over ``window``;
    custom: ``make`` gives the Column from the panel's columns; its rolling functions
    count the panel's timestamps if given ``number=NUMBER``."""

    name: str
    kind: str = "raw"
    column: str = ""
    method: str = ""
    window: int = 0
    least: int | None = None
    make: Callable[[], Column] | None = None

    @property
    def needs(self) -> set[str]:
        return {self.column} if self.column else set()


def raw(name: str, column: str | None = None) -> Factor:
    return Factor(name, "raw", column or name)


def roll(name: str, column: str, method: str, window: int, least: int | None = None) -> Factor:
    return Factor(name, "rolling", column, method, window, least)


def custom(name: str, make: Callable[[], Column]) -> Factor:
    return Factor(name, "custom", make=make)


# The built-in factors.
RAW = tuple(raw(n) for n in "amihud rv_amihud path_efficiency vwap_gap signed_volume_imbalance aggressive_buy_ratio trade_intensity return_1h realized_vol buy_volume_share impact_imbalance close_location downside_upside_vol_ratio path_churn".split())
ROLLING = (
    roll("amihud_z60", "amihud", "zscore", 60),
    roll("momentum_20", "close", "change", 20),
    roll("momentum_60", "close", "change", 60),
    roll("vol_z20", "realized_vol", "zscore", 20),
    roll("imbalance_ma20", "signed_volume_imbalance", "mean", 20),
    roll("imbalance_ma60", "signed_volume_imbalance", "mean", 60),
    roll("buy_ratio_z20", "aggressive_buy_ratio", "zscore", 20),
    roll("intensity_z60", "trade_intensity", "zscore", 60),
)


def required(factors: list[Factor], extra: tuple[str, ...] = ()) -> set[str]:
    """Panel columns that the factors need, and close."""
    return {"close", *extra}.union(*(f.needs for f in factors))


def usable(factors: list[Factor], columns: list[str]) -> tuple[list[Factor], dict[str, str]]:
    """The factors whose columns are there, and why the others are left out."""
    good, bad = [], {}
    for f in factors:
        if missing := f.needs - set(columns):
            bad[f.name] = f"no column {', '.join(sorted(missing))}"
        elif f.kind == "rolling" and f.method not in METHODS:
            bad[f.name] = f"no method {f.method}"
        else:
            good.append(f)
    return good, bad


def column_of(f: Factor) -> Column:
    if f.kind == "raw":
        return F.col(f.column)
    if f.kind == "custom":
        return f.make()
    method = getattr(rolling, f.method)
    least = {"least": f.least} if f.least and f.method in ("mean", "std", "zscore") else {}
    return method(f.column, f.window, number=NUMBER, **least)


def wide(panel: DataFrame, factors: list[Factor]) -> DataFrame:
    """(ts, symbol, a column per factor); factors that can't be computed are left out."""
    good, _ = usable(factors, panel.columns)
    return numbered(panel).select("ts", "symbol", *[column_of(f).cast("double").alias(f.name) for f in good])


def long(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(factor, ts, symbol, value) from a column per factor."""
    names = names or [c for c in table.columns if c not in ("ts", "symbol")]
    return table.unpivot(["ts", "symbol"], names, "factor", "value").select("factor", "ts", "symbol", "value")


def compute(panel: DataFrame, factors: list[Factor]) -> DataFrame:
    return long(wide(panel, factors))


def apply_per_symbol(panel: DataFrame, name: str, f: Callable, columns: list[str]) -> DataFrame:
    """Escape hatch for a pandas function of one symbol's frame, in order of time.
    A symbol's rows go to one worker, so use it for bars, not for ticks."""

    def run(pdf):
        pdf = pdf.sort_values("ts")
        return pdf[["ts", "symbol"]].assign(factor=name, value=f(pdf).astype("float64"))[["factor", "ts", "symbol", "value"]]

    kind = panel.schema["symbol"].dataType.simpleString()
    return panel.select("ts", "symbol", *columns).groupBy("symbol").applyInPandas(run, f"factor string, ts timestamp, symbol {kind}, value double")


def bar_features(bars: DataFrame, ticks: DataFrame | None = None) -> DataFrame:
    """The built-in raw factors' columns from bars with a column ts. Definitions are
    ours where only names are published: see the README. Columns that need single
    ticks come from ``ticks`` (symbol, ts, realized_vol, aggressive_buy_ratio,
    impact_imbalance, downside_upside_vol_ratio), see ``tick_features``."""
    c, w = F.col, rolling.ordered()
    ret = F.try_divide(c("close"), F.lag("close").over(w)) - 1
    made = bars.withColumn("return_1h", ret).withColumns(
        {
            "amihud": F.try_divide(F.abs("return_1h"), c("dollar_volume")),
            "vwap_gap": F.try_divide(c("close"), c("vwap")) - 1,
            "signed_volume_imbalance": c("buy_sell_imbalance"),
            "buy_volume_share": F.try_divide(c("buy_volume"), c("volume")),
            "trade_intensity": F.try_divide(c("tick_count"), c("end_time_ms") - c("start_time_ms")),
            "close_location": F.when(c("high") > c("low"), (c("close") - c("low")) / (c("high") - c("low"))).otherwise(0.5),
            "path_churn": 1 - c("path_efficiency"),
        }
    )
    return made.join(ticks, ["symbol", "ts"], "left").withColumn("rv_amihud", F.try_divide("realized_vol", "dollar_volume")) if ticks is not None else made


def tick_features(trades: DataFrame, interval: str) -> DataFrame:
    """Per time bar, what needs single ticks: deviation of log returns, share of
    taker buys, balance of up and down steps, down to up volatility."""
    from .bars import interval_ms, with_steps

    step = interval_ms(interval)
    t = trades.withColumn("ms", F.unix_millis("ts")).withColumn("edge", F.col("ms") - F.pmod("ms", F.lit(step)))
    s = with_steps(t, ["symbol", "edge"]).withColumn("r", F.when((F.col("price") > 0) & (F.col("price") - F.col("step") > 0), F.ln(F.col("price") / (F.col("price") - F.col("step")))))
    up, down = F.sum(F.when(F.col("step") > 0, F.col("step")).otherwise(0.0)), F.sum(F.when(F.col("step") < 0, -F.col("step")).otherwise(0.0))
    square = lambda cond: F.sqrt(F.sum(F.when(cond, F.col("r") * F.col("r")).otherwise(0.0)))
    return s.groupBy("symbol", "edge").agg(
        F.stddev_samp("r").alias("realized_vol"),
        F.avg(F.when(~F.col("is_buyer_maker"), 1.0).otherwise(0.0)).alias("aggressive_buy_ratio"),
        F.try_divide(up - down, up + down).alias("impact_imbalance"),
        F.try_divide(square(F.col("r") < 0), square(F.col("r") > 0)).alias("downside_upside_vol_ratio"),
    ).select("symbol", F.timestamp_millis("edge").alias("ts"), "realized_vol", "aggressive_buy_ratio", "impact_imbalance", "downside_upside_vol_ratio")


def feature_set(panel: DataFrame, windows: tuple[int, ...] = (5, 10, 20, 60, 120)) -> DataFrame:
    """Returns, and per window the return, mean, deviation, volume mean, momentum
    and annualized volatility, each over a full window of the symbol's own rows. Returns
    from a close of 0 are infinite or NaN, but for log_return, which is null there."""
    c = F.col
    df = panel.withColumn("return", rolling.quotient("close", rolling.lag("close")) - 1)
    df = df.withColumn("log_return", F.when((c("close") > 0) & (rolling.lag("close") > 0), F.ln(c("close") / rolling.lag("close"))))
    for n in windows:
        past = rolling.quotient("close", rolling.lag("close", n)) - 1
        df = df.withColumns({f"return_{n}": past, f"sma_{n}": rolling.mean("close", n, n), f"std_{n}": rolling.std("close", n, n), f"vol_sma_{n}": rolling.mean("volume", n, n), f"momentum_{n}": past, f"volatility_{n}": rolling.std("return", n, n) * F.sqrt(F.lit(252.0))})
    return df
