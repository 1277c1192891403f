"""Registered queries of streams, of what goes over whole histories by blocks, and of the
bars and factors whose SQL is long."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars, blocks, factors, panel, research
from ..sources import tables
from ..sources.stored import shared_dir
from ..sources.tables import ORDER_PRICES, TRADES
from ..streaming import bars as streaming
from . import queries as base
from .queries import _4H, _threshold_sql, query

# Streams

#: How late ticks of the replayed streams may be; what that leaves waiting is given as open.
_LATE = "1 days"


def _replayed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], fold: streaming.TimeFold | streaming.ThresholdFold) -> DataFrame:
    """The trades as a stream that is read to its end: bars given, and those still open."""
    folder = f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}"
    trades = tables.trades(spark, sf_dir)
    trades.write.parquet(f"{folder}/in")
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set(*streaming.PROVIDER)
    made = make(session.readStream.schema(trades.schema).parquet(f"{folder}/in"))
    query = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    streaming.open_bars(session, f"{folder}/state", fold, late=_LATE).write.parquet(f"{folder}/open")
    given, still = (spark.read.schema(made.schema).parquet(f"{folder}/{x}") for x in ("out", "open"))
    return given.unionByName(still)


@query(base.ORACLE_SQL["bars_time_moves"])
def stream_time_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves within four-hour bars from a stream."""
    b = _replayed(spark, sf_dir, lambda s: streaming.time_bars(s, "4h", advanced=True, late=_LATE), streaming.TimeFold(_4H))
    return b.select("symbol", "start_time_ms", "up_move_ratio", "down_move_ratio", "reversals", "tick_interval_mean", F.round("tick_interval_std", 4).alias("tick_interval_std"), "path_efficiency")


@query(base.ORACLE_SQL["bars_dollar_auto"])
def stream_dollar_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dollar bars with each day's own threshold from a stream."""
    fold = streaming.ThresholdFold(True, 0, 3, 10, 0)
    b = _replayed(spark, sf_dir, lambda s: streaming.threshold_bars(s, "dollar", "auto", late=_LATE, lookback=3, bars_per_day=10, discard_months=0), fold)
    return b.select("symbol", "bar_id", "end_time_ms", "open", "close", F.round("dollar_volume", 1).alias("dollar_volume"), "tick_count")


# Threshold bars

#: The automatic dollar bars' SQL with quantities as amounts.
_VOLUME_AUTO_SQL = (
    base.ORACLE_SQL["bars_dollar_auto"]
    .replace("round(price * quantity, 6)::DECIMAL(28,8) AS amount", "quantity::DECIMAL(28,8) AS amount")
    .replace("sum(price * quantity) AS total", "sum(quantity) AS total")
    .replace("sum(part) AS dollar_volume", "sum(part) AS volume")
    .replace("round(dollar_volume, 1) AS dollar_volume", "round(volume, 4) AS volume")
)


@query(_VOLUME_AUTO_SQL)
def bars_volume_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.volume_bars(tables.trades(spark, sf_dir), "auto", lookback=3, bars_per_day=10, discard_months=0, advanced=False)
    return b.select("symbol", "bar_id", "end_time_ms", "open", "close", F.round("volume", 4).alias("volume"), "tick_count")


_MORE = ("price_std", "volume_std", "up_move_ratio", "down_move_ratio", "reversals", "buy_sell_imbalance", "spread_proxy", "skewness", "kurtosis", "max_trade_volume", "max_trade_ratio", "tick_interval_mean", "tick_interval_std", "path_efficiency")


def _advanced_sql(pieces: str, quantity: str, notional: str) -> str:
    """Advanced columns from ``pieces``, common table expressions that end with p."""
    return f"""{pieces}, x AS (
  SELECT symbol, bar_id, ts, trade_id, price, is_buyer_maker, ms, {quantity} AS q, {notional} AS a, price - lag(price) OVER w AS step, ms - lag(ms) OVER w AS gap, avg(price) OVER (PARTITION BY symbol, bar_id) AS m FROM p WINDOW w AS (PARTITION BY symbol, bar_id ORDER BY ts, trade_id)
), y AS (
  SELECT *, last_value(CASE WHEN step <> 0 THEN sign(step) END IGNORE NULLS) OVER (PARTITION BY symbol, bar_id ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS way FROM x
), z AS (
  SELECT symbol, bar_id, count(*) AS n, min(price) AS low, max(price) AS high, arg_min(price, (ts, trade_id)) AS open, arg_max(price, (ts, trade_id)) AS close, sum(q) AS v, coalesce(sum(q) FILTER (WHERE NOT is_buyer_maker), 0) AS buy, sum(a) AS dv,
    coalesce(stddev_samp(price), 0) AS ps, coalesce(stddev_samp(q), 0) AS qs, count(*) FILTER (WHERE step > 0) AS up, count(*) FILTER (WHERE step < 0) AS down, count(*) FILTER (WHERE step <> 0 AND sign(step) <> way) AS reversals,
    sum((price - m) ** 2) AS m2, sum((price - m) ** 3) AS m3, sum((price - m) ** 4) AS m4, max(q) AS most, coalesce(avg(gap), 0) AS gm, coalesce(stddev_samp(gap), 0) AS gs, sum(abs(step)) AS path
  FROM y GROUP BY symbol, bar_id)
SELECT symbol, bar_id, round(ps, 4) AS price_std, round(qs, 4) AS volume_std, round(up / n, 4) AS up_move_ratio, round(down / n, 4) AS down_move_ratio, reversals, round(CASE WHEN v > 0 THEN (2 * buy - v) / v ELSE 0 END, 4) AS buy_sell_imbalance,
  round(CASE WHEN high > low AND dv > 0 THEN (high - low) / (dv / v) ELSE 0 END, 4) AS spread_proxy, round(CASE WHEN n >= 3 AND high > low THEN sqrt(n) * m3 / m2 ** 1.5 ELSE 0 END, 4) AS skewness,
  round(CASE WHEN n >= 4 AND high > low THEN n * m4 / m2 ** 2 - 3 ELSE 0 END, 4) AS kurtosis, round(most, 4) AS max_trade_volume, round(CASE WHEN v > 0 THEN most / v ELSE 0 END, 4) AS max_trade_ratio,
  round(gm, 4) AS tick_interval_mean, round(gs, 4) AS tick_interval_std, round(CASE WHEN path > 0 THEN abs(close - open) / path ELSE 1 END, 4) AS path_efficiency FROM z"""


def _pieces_sql(amount: str, threshold: str) -> str:
    return _threshold_sql(amount, threshold).split("), b AS (")[0] + ")"


@query(_advanced_sql(_pieces_sql("volume", "100"), "part", "part * price"), 4)
def bars_volume_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.volume_bars(tables.trades(spark, sf_dir), 100).select("symbol", "bar_id", *_MORE)


@query(_advanced_sql(_pieces_sql("dollar", "777.77"), "part / price", "part"), 4)
def bars_dollar_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.dollar_bars(tables.trades(spark, sf_dir), 777.77).select("symbol", "bar_id", *_MORE)


@query(_advanced_sql(f"WITH {TRADES}, p AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) - 1) // 50 AS bar_id FROM trades)", "quantity", "price * quantity"), 4)
def bars_tick_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.tick_bars(tables.trades(spark, sf_dir), 50).select("symbol", "bar_id", *_MORE)


# Histories by blocks

_DAY = "strftime(ts, '%Y-%m-%d') AS day"


def _days(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), *columns)


def _q(span: int) -> str:
    return repr(1 - 2 / (span + 1))


@query(
    f"""WITH RECURSIVE {ORDER_PRICES}, h AS MATERIALIZED (SELECT symbol, ts, close::DOUBLE AS close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM history), m AS (
  SELECT symbol, ts, k, close AS n1, 1::DOUBLE AS d1, close AS n2, 1::DOUBLE AS d2, 0::DOUBLE AS line, 0::DOUBLE AS ns, 1::DOUBLE AS ds FROM h WHERE k = 1
  UNION ALL
  SELECT symbol, ts, k, n1, d1, n2, d2, line, {_q(9)} * ns + line, {_q(9)} * ds + 1 FROM (
    SELECT symbol, ts, k, n1, d1, n2, d2, n1 / d1 - n2 / d2 AS line, ns, ds FROM (
      SELECT h.symbol, h.ts, h.k, {_q(12)} * n1 + close AS n1, {_q(12)} * d1 + 1 AS d1, {_q(26)} * n2 + close AS n2, {_q(26)} * d2 + 1 AS d2, ns, ds FROM m JOIN h ON h.symbol = m.symbol AND h.k = m.k + 1))
), r AS (SELECT *, line - ns / ds AS hist, lag(line - ns / ds) OVER (PARTITION BY symbol ORDER BY k) AS was FROM m)
SELECT symbol, {_DAY}, round(line, 3) AS macd, round(ns / ds, 3) AS macd_signal, round(hist, 3) AS macd_histogram, CASE WHEN hist > 0 AND was <= 0 THEN 1 WHEN hist < 0 AND was >= 0 THEN -1 ELSE 0 END::BIGINT AS macd_cross,
  CASE WHEN hist > 0 AND was <= 0 AND line > 0 THEN 1 WHEN hist < 0 AND was >= 0 AND line < 0 THEN -1 ELSE 0 END::BIGINT AS macd_rule FROM r""",
    3,
)
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(research.macd(tables.order_prices(spark, sf_dir)), "macd", "macd_signal", "macd_histogram", "macd_cross", "macd_rule")


@query(
    f"""WITH {ORDER_PRICES}, h AS (SELECT symbol, ts, close::DOUBLE AS close, quantile_cont(close::DOUBLE, 0.9) OVER (w ROWS 499 PRECEDING) AS q, list(close::DOUBLE) OVER (w ROWS 249 PRECEDING) AS l FROM history WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, {_DAY}, round(q, 3) AS close_q90, round((len(list_filter(l, lambda x: x < close)) + (len(list_filter(l, lambda x: x = close)) + 1) / 2) / len(l), 3) AS close_rank FROM h""",
    3,
)
def long_order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantile over 500 rows and a rank over 250."""
    return _days(blocks.order_statistics(tables.order_prices(spark, sf_dir), {"close_q90": ("close", 500, 0.9), "close_rank": ("close", 250, None)}), "close_q90", "close_rank")


#: Order lines as daily bars: the number of the line is the symbol, even suppliers buy.
LINES = """lines AS (
  SELECT 'L' || l_linenumber AS symbol, l_shipdate AS ts, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_partkey, l_extendedprice)) AS close, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low, sum(l_quantity) AS volume, sum(l_extendedprice) AS dollar_volume,
    coalesce(sum(l_quantity) FILTER (WHERE l_suppkey % 2 = 0), 0) AS buy_volume, coalesce(sum(l_quantity) FILTER (WHERE l_suppkey % 2 = 1), 0) AS sell_volume
  FROM lineitem WHERE l_quantity > 0 GROUP BY ALL)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, price = F.col, F.col("l_extendedprice") / F.col("l_quantity")
    of = lambda odd: F.sum(F.when(c("l_suppkey") % 2 == odd, c("l_quantity")).otherwise(0.0))
    lines = tables.table(spark, sf_dir, "lineitem").filter("l_quantity > 0")
    day = lines.groupBy(F.concat(F.lit("L"), "l_linenumber").alias("symbol"), c("l_shipdate").cast("timestamp").alias("ts")).agg(
        F.max_by(price, F.struct("l_orderkey", "l_partkey", "l_extendedprice")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("dollar_volume"), of(0).alias("buy_volume"), of(1).alias("sell_volume")
    )
    return day.withColumns({"ofi": (c("buy_volume") - c("sell_volume")) / c("volume"), "realized_vol": F.ln(c("high") / c("low"))})


@query(
    f"""WITH RECURSIVE {LINES}, n AS MATERIALIZED (
  SELECT *, (buy_volume - sell_volume) / volume AS ofi, ln(high / low) AS rv, row_number() OVER w AS k, close / (sum(dollar_volume) OVER (w ROWS 19 PRECEDING) / sum(volume) OVER (w ROWS 19 PRECEDING)) - 1 AS dev FROM lines WINDOW w AS (PARTITION BY symbol ORDER BY ts)
), e AS (
  SELECT symbol, k, ofi AS a, 1::DOUBLE AS d FROM n WHERE k = 1
  UNION ALL SELECT n.symbol, n.k, {_q(10)} * a + ofi, {_q(10)} * d + 1 FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1
), y AS MATERIALIZED (
  SELECT n.symbol, n.ts, n.k, dev, quantile_cont(abs(dev), 0.9) OVER (w ROWS 499 PRECEDING) AS entry, abs(a / d) < 0.08 AND rv < lag(rv) OVER w AS calm,
    sell_volume < lag(sell_volume) OVER w AND lag(sell_volume) OVER w < lag(sell_volume, 2) OVER w AND lag(sell_volume, 2) OVER w < lag(sell_volume, 3) OVER w AND lag(sell_volume, 3) OVER w < lag(sell_volume, 4) OVER w AS sells,
    buy_volume < lag(buy_volume) OVER w AND lag(buy_volume) OVER w < lag(buy_volume, 2) OVER w AND lag(buy_volume, 2) OVER w < lag(buy_volume, 3) OVER w AND lag(buy_volume, 3) OVER w < lag(buy_volume, 4) OVER w AS buys
  FROM n JOIN e USING (symbol, k) WINDOW w AS (PARTITION BY n.symbol ORDER BY n.k)
), s AS MATERIALIZED (SELECT *, CASE WHEN dev < -entry AND calm AND sells THEN 1 WHEN dev > entry AND calm AND buys THEN -1 ELSE 0 END AS signal FROM y), p AS (
  SELECT symbol, ts, k, entry, signal, signal AS position FROM s WHERE k = 1
  UNION ALL SELECT s.symbol, s.ts, s.k, s.entry, s.signal, CASE WHEN s.signal <> 0 THEN s.signal WHEN abs(s.dev) <= 0.0005 THEN 0 ELSE p.position END FROM p JOIN s ON s.symbol = p.symbol AND s.k = p.k + 1)
SELECT symbol, {_DAY}, round(entry, 6) AS entry, signal::BIGINT AS signal, position::BIGINT AS position FROM p"""
)
def reversion_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five-bar rule with its own limits and exit, on a long history."""
    made = research.reversion_position(research.vwap_features(_lines(spark, sf_dir)))
    return _days(made, "entry", "signal", "position")


# Built-in factors


def _rolling_sql(f: factors.Factor) -> str:
    n, x = f.window, f.column
    w = f"(PARTITION BY symbol ORDER BY num RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    if f.method == "mean":
        return f"avg({x}) OVER {w}"
    if f.method == "zscore":
        return f"CASE WHEN count({x}) OVER {w} >= 2 AND stddev_samp({x}) OVER {w} > 0 THEN ({x} - avg({x}) OVER {w}) / stddev_samp({x}) OVER {w} END"
    past = f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY num RANGE BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING)"
    return f"last_value({x} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY num) / nullif({past}, 0) - 1"


_BUILTIN_SQL = f"""{base._TIME}, r AS (
  SELECT *, CASE WHEN price > 0 AND price - step > 0 THEN ln(price / (price - step)) END AS r FROM d
), b AS (
  SELECT symbol, edge, make_timestamp(edge * 1000) AS ts, arg_min(price, (ts, trade_id)) AS open, arg_max(price, (ts, trade_id)) AS close, max(price) AS high, min(price) AS low, sum(quantity) AS volume, coalesce(sum(quantity) FILTER (WHERE NOT is_buyer_maker), 0) AS buy, sum(notional) AS dv,
    count(*) AS n, max(ms) AS last_ms, sum(abs(step)) AS path, stddev_samp(r) AS realized_vol, avg(CASE WHEN is_buyer_maker THEN 0.0 ELSE 1.0 END) AS aggressive_buy_ratio,
    coalesce(sum(step) FILTER (WHERE step > 0), 0) AS up, coalesce(-sum(step) FILTER (WHERE step < 0), 0) AS down, sqrt(coalesce(sum(r * r) FILTER (WHERE r < 0), 0)) AS rd, sqrt(coalesce(sum(r * r) FILTER (WHERE r > 0), 0)) AS ru
  FROM r GROUP BY symbol, edge
), f0 AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS return_1h, CASE WHEN path > 0 THEN abs(close - open) / path ELSE 1 END AS path_efficiency, dense_rank() OVER (ORDER BY ts) AS num FROM b
), f1 AS (
  SELECT *, abs(return_1h) / nullif(dv, 0) AS amihud, realized_vol / nullif(dv, 0) AS rv_amihud, close / nullif(CASE WHEN volume > 0 THEN dv / volume ELSE 0 END, 0) - 1 AS vwap_gap, CASE WHEN volume > 0 THEN (2 * buy - volume) / volume ELSE 0 END AS signed_volume_imbalance,
    n / nullif(last_ms - edge, 0) AS trade_intensity, buy / nullif(volume, 0) AS buy_volume_share, (up - down) / nullif(up + down, 0) AS impact_imbalance, CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END AS close_location,
    rd / nullif(ru, 0) AS downside_upside_vol_ratio, 1 - path_efficiency AS path_churn FROM f0
), f2 AS (SELECT symbol, ts, {", ".join(f.column for f in factors.RAW)}, {", ".join(f"{_rolling_sql(f)} AS {f.name}" for f in factors.ROLLING)} FROM f1)
{" UNION ALL ".join(f"SELECT '{f.name}' AS factor, strftime(ts, '%Y-%m-%d %H:%M') AS ts, symbol, round({f.name}, 6) AS value FROM f2" for f in (*factors.RAW, *factors.ROLLING))}"""


@query(_BUILTIN_SQL)
def factors_builtin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in factors on four-hour bars; a change from a close of 0 is none."""
    t = tables.trades(spark, sf_dir)
    b = bars.time_bars(t, "4h").withColumn("ts", F.timestamp_millis("start_time_ms"))
    made = factors.compute(factors.bar_features(b, factors.tick_features(t, "4h")), [*factors.RAW, *factors.ROLLING])
    return made.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd HH:mm"), "value": panel.finite("value")})
