"""Registered queries of the research operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rolling
from ..operators import bars, factors, research
from ..sources import tables
from ..sources.stored import stored
from ..sources.tables import ORDER_PRICES, PANEL, TRADES
from . import queries as base
from .queries import _DATE, _FACTOR_SQL, _IC_SQL, _LS_SQL, _QR, _dated, _day, query

_STEP = 4 * 3_600_000
#: Four-hour bars as a panel.
BARS = f"""{TRADES}, b AS (
  SELECT symbol, make_timestamp((ms - ms % {_STEP}) * 1000) AS ts, arg_min(price, (ts, trade_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, trade_id)) AS close,
    sum(quantity) AS volume, sum(price * quantity) AS dollar_volume, count(*) AS tick_count, coalesce(sum(quantity) FILTER (WHERE NOT is_buyer_maker), 0) AS buy_volume,
    sum(quantity) - coalesce(sum(quantity) FILTER (WHERE NOT is_buyer_maker), 0) AS sell_volume, max(ms) - min(ms - ms % {_STEP}) AS duration, CASE WHEN sum(quantity) > 0 THEN (2 * coalesce(sum(quantity) FILTER (WHERE NOT is_buyer_maker), 0) - sum(quantity)) / sum(quantity) ELSE 0 END AS ofi
  FROM trades GROUP BY symbol, ms - ms % {_STEP})"""
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
_TS = "epoch_ms(ts) AS ms"


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars.time_bars(tables.trades(spark, sf_dir), "4h", advanced=False)
    ofi = F.coalesce(F.try_divide(F.col("buy_volume") - F.col("sell_volume"), F.col("volume")), F.lit(0.0))
    return b.select(F.timestamp_millis("start_time_ms").alias("ts"), "symbol", "open", "high", "low", "close", "volume", "dollar_volume", "tick_count", "vwap", "buy_volume", "sell_volume", (F.col("end_time_ms") - F.col("start_time_ms")).alias("duration"), ofi.alias("ofi"))


def _ema_sql(source: str, x: str, span: int, name: str) -> str:
    """(symbol, ts, name): the exponential mean over all rows before, by row numbers k of ``source``."""
    q = 1 - 2 / (span + 1)
    power = f"pow({q!r}, a.k - b.k)"
    return f"(SELECT a.symbol, a.ts, sum(b.{x} * {power}) / sum({power}) AS {name} FROM {source} a JOIN {source} b ON a.symbol = b.symbol AND b.k <= a.k GROUP BY ALL)"


def _z_sql(x: str, n: int) -> str:
    v = f"OVER (PARTITION BY symbol ORDER BY ts ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {v} >= 2 AND stddev_samp({x}) {v} > 0 THEN ({x} - avg({x}) {v}) / stddev_samp({x}) {v} END"


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("symbol", F.unix_millis("ts").alias("ms"), *columns)


@query(f"WITH {BARS} SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, round(arg_max(close, ts), 6) AS close, round(avg(ofi), 6) AS ofi, round(sum(volume), 6) AS volume FROM b GROUP BY symbol, strftime(ts, '%Y-%m-%d')")
def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.daily(_bars(spark, sf_dir), means=("ofi",), sums=("volume",)).select("symbol", _day("ts").alias("day"), "close", "ofi", "volume")


@query(
    f"""WITH {BARS}, c AS (SELECT *, (CASE WHEN volume > 0 THEN dollar_volume / volume ELSE 0 END - low) / nullif(high - low, 0) AS centroid FROM b)
SELECT symbol, {_TS}, round(avg(ofi) OVER (w ROWS 6 PRECEDING), 6) AS ofi_7, round(avg(ofi) OVER (w ROWS 13 PRECEDING), 6) AS ofi_14, round(avg(centroid) OVER (w ROWS 6 PRECEDING), 6) AS centroid_7 FROM c {_W}"""
)
def microstructure_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.microstructure_momentum(research.centroid(_bars(spark, sf_dir)), ["ofi", "centroid"], (7, 14)), "ofi_7", "ofi_14", "centroid_7")


@query(
    f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r1, close / lag(close, 7) OVER w - 1 AS rn FROM b {_W})
SELECT symbol, {_TS}, round(rn / nullif(CASE WHEN count(r1) OVER (w ROWS 6 PRECEDING) >= 2 THEN stddev_samp(r1) OVER (w ROWS 6 PRECEDING) END, 0), 6) AS vam_7 FROM r {_W}"""
)
def vol_adjusted_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.vol_adjusted_momentum(_bars(spark, sf_dir), 7), "vam_7")


@query(f"WITH {BARS} SELECT symbol, {_TS}, round(avg(ofi) OVER (w ROWS 6 PRECEDING) - avg(ofi) OVER (w ROWS 20 PRECEDING), 6) AS flow_acceleration, round(0.5 * avg(ofi) OVER (w ROWS 6 PRECEDING) + 0.3 * avg(ofi) OVER (w ROWS 13 PRECEDING) + 0.2 * avg(ofi) OVER (w ROWS 20 PRECEDING), 6) AS blended_flow FROM b {_W}")
def flow_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.blended_flow(research.flow_acceleration(_bars(spark, sf_dir))), "flow_acceleration", "blended_flow")


@query(
    f"""WITH {BARS}, l AS (SELECT *, lag(ofi) OVER w AS p FROM b {_W}), x AS (SELECT *, CASE WHEN p IS NOT NULL THEN ofi END AS a FROM l),
s AS (SELECT symbol, ts, count(a) OVER v AS n, covar_samp(a, p) OVER v AS cv, stddev_samp(a) OVER v * stddev_samp(p) OVER v AS d FROM x WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING))
SELECT symbol, {_TS}, round(CASE WHEN n >= 3 AND d > 1e-18 THEN cv / d END, 5) AS autocorrelation FROM s""",
    5,
)
def rolling_autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.autocorrelation(_bars(spark, sf_dir), "ofi", 14), "autocorrelation")


@query(
    f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r1, close / lag(close, 20) OVER w - 1 AS rn FROM b {_W}), m AS (SELECT ts, r1 AS mr, rn AS mn FROM r WHERE symbol = 'click'),
j AS (SELECT r.*, mr, mn FROM r LEFT JOIN m USING (ts)), k AS (
  SELECT *, CASE WHEN count(r1 + mr) OVER v >= 2 THEN covar_samp(r1, mr) OVER v END / nullif(var_samp(mr) OVER v, 0) AS beta, CASE WHEN count(r1 + mr) OVER l >= 2 THEN covar_samp(r1, mr) OVER l END / nullif(var_samp(mr) OVER l, 0) AS beta_60
  FROM j WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING), l AS (PARTITION BY symbol ORDER BY ts ROWS 59 PRECEDING)), e AS (SELECT *, r1 - beta * mr AS e FROM k)
SELECT symbol, {_TS}, round(rn - mn, 4) + 0.0 AS relative_strength, round(beta, 4) + 0.0 AS beta, round(beta - beta_60, 4) + 0.0 AS beta_change, round(CASE WHEN count(e) OVER v >= 2 THEN stddev_samp(e) OVER v END, 4) + 0.0 AS idiosyncratic_vol
FROM e WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)""",
    4,
)
def benchmark_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.against_benchmark(_bars(spark, sf_dir), "click"), "relative_strength", "beta", "beta_change", "idiosyncratic_vol")


_KYLE_SQL = f"""WITH {BARS}, r AS (SELECT *, close - lag(close) OVER w AS dp, close / lag(close) OVER w - 1 AS ret, buy_volume - sell_volume AS delta, abs(close - open) / nullif(dollar_volume, 0) AS impact FROM b {_W}), x AS (SELECT *, CASE WHEN dp IS NOT NULL THEN delta END AS a FROM r),
k AS (SELECT *, CASE WHEN count(a) OVER v >= 3 AND var_samp(a) OVER v > 0 THEN covar_samp(a, dp) OVER v / var_samp(a) OVER v END AS lambda_20 FROM x WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))"""


def _with_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir)
    impact = F.try_divide(F.abs(F.col("close") - F.col("open")), F.col("dollar_volume"))
    return research.returns(b).withColumns({"delta": F.col("buy_volume") - F.col("sell_volume"), "impact": impact})


@query(
    f"""{_KYLE_SQL}, d AS (SELECT *, close / lag(close, 7) OVER w - 1 AS rn, volume - lag(volume, 7) OVER w AS dv, impact - lag(impact) OVER w AS di FROM k {_W})
SELECT symbol, {_TS}, (sign(rn) * sign(dv))::DOUBLE + 0.0 AS divergence, round(ofi * abs(ret), 6) + 0.0 AS smart_money, round(abs(ofi) * lambda_20, 4) + 0.0 AS asymmetry, round(-1e6 * avg(di) OVER (w ROWS 6 PRECEDING), 4) + 0.0 AS liquidity_momentum FROM d {_W}"""
)
def relational_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = research.relational(research.kyle_lambda(_with_flow(spark, sf_dir)))
    return _out(made.withColumns({"asymmetry": F.round("asymmetry", 4), "liquidity_momentum": F.round(F.col("liquidity_momentum") * 1e6, 4)}), "divergence", "smart_money", "asymmetry", "liquidity_momentum")


@query(f"WITH {BARS} SELECT symbol, {_TS}, round({_z_sql('ofi', 20)}, 5) AS ofi_z20, round({_z_sql('ofi', 100)}, 5) AS ofi_z100, round({_z_sql('ofi', 500)}, 5) AS ofi_z500 FROM b", 5)
def multi_window_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.zscores(_bars(spark, sf_dir), ["ofi"]), "ofi_z20", "ofi_z100", "ofi_z500")


@query(
    f"""{_FACTOR_SQL}, z AS (SELECT factor, ts, symbol, CASE WHEN stddev_samp(value) OVER d > 0 THEN (value - avg(value) OVER d) / stddev_samp(value) OVER d END AS z FROM longf WINDOW d AS (PARTITION BY factor, ts))
SELECT 'blend' AS factor, {_DATE}, symbol, round(sum(z) / nullif(count(z), 0), 6) AS value FROM z GROUP BY ts, symbol"""
)
def composite_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(research.composite(base._factors(spark, sf_dir)[0], {"momentum_3": 0.5, "volume_z5": 0.5}, "blend"))


@query(
    f"""WITH {PANEL}, z AS (
  SELECT *, CASE WHEN count(close) OVER w >= 2 AND stddev_samp(close) OVER w > 0 THEN (close - avg(close) OVER w) / stddev_samp(close) OVER w END AS z_own, CASE WHEN stddev_samp(close) OVER d > 0 THEN (close - avg(close) OVER d) / stddev_samp(close) OVER d END AS z_cross
  FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), d AS (PARTITION BY ts))
SELECT {_DATE}, symbol, round(z_own, 6) AS z_own, round(z_cross, 6) AS z_cross, round((z_own + z_cross) / 2, 6) AS z_hybrid FROM z"""
)
def zscore_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(research.zscore_modes(tables.panel(spark, sf_dir), "close", 10)).select("ts", "symbol", "z_own", "z_cross", "z_hybrid")


@query(f"{_IC_SQL}, h AS (SELECT factor, period, avg(ic) FILTER (WHERE ts < '2024-01-15') AS a, avg(ic) FILTER (WHERE ts >= '2024-01-15') AS b FROM ic GROUP BY ALL) SELECT factor, period, round(a, 6) AS ic_in, round(b, 6) AS ic_out, sign(a) = sign(b) AS same_sign FROM h")
def ic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.split_test(base._ic(spark, sf_dir), "2024-01-15")


@query(
    f"""{_FACTOR_SQL}, f AS (SELECT * FROM longf WHERE value IS NOT NULL), k AS (SELECT factor, ts, symbol, rank() OVER (PARTITION BY factor, ts ORDER BY value) + (count(*) OVER (PARTITION BY factor, ts, value) - 1) / 2 AS k FROM f),
p AS (SELECT a.factor AS f1, b.factor AS f2, a.ts, CASE WHEN count(*) >= 3 AND stddev_pop(a.k) > 0 AND stddev_pop(b.k) > 0 THEN covar_pop(a.k, b.k) / (stddev_pop(a.k) * stddev_pop(b.k)) END AS rho FROM k a JOIN k b ON a.ts = b.ts AND a.symbol = b.symbol AND a.factor < b.factor GROUP BY ALL)
SELECT f1, f2, round(avg(rho), 6) AS rho, abs(avg(rho)) > 0.7 AS redundant FROM p GROUP BY f1, f2"""
)
def factor_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.factor_correlation(base._factors(spark, sf_dir)[0])


@query(f"{_LS_SQL}, c AS (SELECT factor, bps, gross, turnover FROM p CROSS JOIN (SELECT unnest([0.0, 10.0, 30.0]) AS bps)) SELECT factor, bps::DOUBLE AS bps, round(product(1 + gross - turnover * bps / 10000) - 1, 5) AS total_return, round(sum(gross) / sum(turnover) * 10000, 5) AS breakeven_bps FROM c GROUP BY factor, bps", 5)
def fee_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.fee_sensitivity(base._periods(spark, sf_dir), [0, 10, 30])


@query(f"{_FACTOR_SQL}, m AS (SELECT factor, quantile, ts, avg(ret_1) AS ret FROM data GROUP BY ALL) SELECT factor, quantile, {_DATE}, round(product(1 + ret) OVER (PARTITION BY factor, quantile ORDER BY ts), 6) AS nav FROM m")
def quantile_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(research.quantile_curves(base._data(spark, sf_dir)[0])).select("factor", "quantile", "ts", "nav")


@query(f"{_FACTOR_SQL}, {_QR} SELECT a.factor, round(avg(sign(b.mean_1 - a.mean_1)), 6) AS tau FROM qr a JOIN qr b ON a.factor = b.factor AND a.quantile < b.quantile GROUP BY a.factor")
def quantile_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import analysis

    return research.monotonicity(analysis.quantile_returns(base._data(spark, sf_dir)[0], base.PERIODS))


@query(
    f"""{_FACTOR_SQL}, q AS (SELECT factor, strftime(date_trunc('month', ts), '%Y-%m-%d') AS part, quantile, avg(ret_1) AS m FROM data GROUP BY ALL), t AS (SELECT a.factor, a.part, avg(sign(b.m - a.m)) AS tau FROM q a JOIN q b ON a.factor = b.factor AND a.part = b.part AND a.quantile < b.quantile GROUP BY ALL),
s AS (SELECT factor, part, arg_max(m, quantile) - arg_min(m, quantile) AS spread FROM q GROUP BY ALL) SELECT factor, part, round(spread, 6) AS spread, round(tau, 6) AS tau FROM s LEFT JOIN t USING (factor, part)"""
)
def quantile_sub_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.sub_periods(base._data(spark, sf_dir)[0])


@query(
    f"""{_FACTOR_SQL}, f AS (SELECT factor, ts, symbol, value, row_number() OVER (PARTITION BY factor, ts ORDER BY value DESC, symbol) AS u, row_number() OVER (PARTITION BY factor, ts ORDER BY value, symbol) AS d FROM longf WHERE value IS NOT NULL)
SELECT factor, {_DATE}, symbol, round((CASE WHEN u <= 5 THEN 0.1 ELSE 0 END - CASE WHEN d <= 5 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS weight FROM f WHERE (CASE WHEN u <= 5 THEN 0.1 ELSE 0 END - CASE WHEN d <= 5 THEN 0.1 ELSE 0 END) <> 0"""
)
def top_bottom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(research.top_bottom_weights(base._factors(spark, sf_dir)[0], 5))


@query(
    f"""{_FACTOR_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, f AS (SELECT factor, ts, symbol, row_number() OVER (PARTITION BY factor, ts ORDER BY value DESC, symbol) AS k, row_number() OVER (PARTITION BY factor, symbol ORDER BY ts) AS i FROM longf WHERE value IS NOT NULL),
h AS (SELECT factor, symbol, ts, i, k <= 10 AS held FROM f WHERE i = 1 UNION ALL SELECT f.factor, f.symbol, f.ts, f.i, f.k <= 10 OR (h.held AND f.k <= 25) FROM h JOIN f ON f.factor = h.factor AND f.symbol = h.symbol AND f.i = h.i + 1)
SELECT factor, {_DATE}, symbol FROM h WHERE held"""
)
def buffer_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(research.buffer_zone(base._factors(spark, sf_dir)[0], 10, 15))


@query(
    f"""{_IC_SQL}, held AS (SELECT factor, period, ts, avg(ic) OVER (PARTITION BY factor, period ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 2 PRECEDING) AS weight FROM ic)
SELECT factor, period, {_DATE}, round(weight, 6) AS weight, round(first_value(weight) OVER (PARTITION BY factor, period, date_trunc('month', ts) ORDER BY ts), 6) AS monthly FROM held"""
)
def ic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = base._ic(spark, sf_dir)
    held = research.ic_weights(ic, 5, 2, monthly=True).withColumnRenamed("weight", "monthly")
    return _dated(research.ic_weights(ic, 5, 2).join(held, ["factor", "period", "ts"]))


@query(
    f"""WITH {ORDER_PRICES}, h AS (SELECT ts, symbol, 1 + close / 1e7 AS close, lead(ts) OVER w AS nx, (1 + lead(close) OVER w / 1e7) / (1 + close / 1e7) - 1 AS ret FROM history {_W}), p AS (SELECT symbol AS factor, ts, ret AS net FROM h WHERE nx IS NOT NULL),
s AS (SELECT factor, min(ts)::DATE AS a, max(ts)::DATE AS b FROM p GROUP BY factor), f AS (
  SELECT factor, row_number() OVER (PARTITION BY factor ORDER BY t) - 1 AS fold, t::DATE AS test_start, (t + INTERVAL 180 DAY)::DATE AS test_end FROM (SELECT factor, unnest(generate_series(a + INTERVAL 365 DAY, b::TIMESTAMP, INTERVAL 90 DAY)) AS t FROM s)),
i AS (SELECT f.*, ts, net FROM p JOIN f USING (factor) WHERE ts::DATE >= test_start - 365 AND ts::DATE < test_end), o AS (SELECT factor, fold, test_start, product(CASE WHEN ts::DATE < test_start THEN 1 + net ELSE 1 END) - 1 AS a, product(CASE WHEN ts::DATE >= test_start THEN 1 + net ELSE 1 END) - 1 AS b FROM i GROUP BY ALL)
SELECT factor, fold, strftime(test_start, '%Y-%m-%d') AS test_start, round(a, 6) AS train_return, round(b, 6) AS test_return FROM o"""
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order priority's slow price as a portfolio of its own."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    h = tables.order_prices(spark, sf_dir).withColumn("close", 1 + F.col("close") / 1e7)
    p = h.select(F.col("symbol").alias("factor"), "ts", (F.lead("close").over(w) / F.col("close") - 1).alias("net")).filter("net is not null")
    return research.walk_forward(p).select("factor", "fold", _day("test_start").alias("test_start"), "train_return", "test_return")


@query(f"{_LS_SQL} SELECT factor, strftime(ts, '%Y-%m') AS month, round(sum(gross - cost), 6) AS total, round(avg(gross - cost), 6) AS mean, count(*) AS n FROM p GROUP BY ALL")
def monthly_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.attribution(base._periods(spark, sf_dir), "month")


@query(f"{_LS_SQL} SELECT factor, extract('hour' FROM ts) AS hour, round(sum(gross - cost), 6) AS total, round(avg(gross - cost), 6) AS mean, count(*) AS n FROM p GROUP BY ALL")
def hourly_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.attribution(base._periods(spark, sf_dir), "hour")


@query(f"{_LS_SQL}, c AS (SELECT factor, multiple, product(1 + gross - turnover * multiple * 5 / 10000) - 1 AS total FROM p CROSS JOIN (SELECT unnest([1.0, 2.0, 3.0]) AS multiple) GROUP BY ALL) SELECT factor, multiple::DOUBLE AS multiple, round(total, 5) AS total_return, total > 0 AS profitable FROM c", 5)
def slippage_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return research.slippage(base._periods(spark, sf_dir), [1, 2, 3], 5.0)


@query(
    f"""{_LS_SQL}, l AS (SELECT factor, ts, gross, lag(gross) OVER (PARTITION BY factor ORDER BY ts) AS g1, gross - cost AS net FROM p), x AS (SELECT *, CASE WHEN g1 IS NOT NULL THEN gross END AS a FROM l),
k AS (SELECT *, avg((net > 0)::INT) OVER h AS rate, avg(CASE WHEN net > 0 THEN net END) OVER h AS win, avg(CASE WHEN net < 0 THEN -net END) OVER h AS loss FROM x WINDOW h AS (PARTITION BY factor ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT factor, {_DATE}, round(CASE WHEN count(a) OVER v >= 3 AND stddev_samp(a) OVER v * stddev_samp(g1) OVER v > 1e-18 THEN covar_samp(a, g1) OVER v / (stddev_samp(a) OVER v * stddev_samp(g1) OVER v) END, 4) AS crowding, round((rate - (1 - rate) * loss / win) / 2, 4) AS kelly
FROM k WINDOW v AS (PARTITION BY factor ORDER BY ts ROWS 19 PRECEDING)""",
    4,
)
def factor_crowding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(research.half_kelly(research.crowding(base._periods(spark, sf_dir)), 10)).select("factor", "ts", "crowding", "kelly")


@query(
    f"""{_FACTOR_SQL}, f AS (SELECT factor, ts, symbol, row_number() OVER (PARTITION BY factor, ts ORDER BY value DESC, symbol) AS u, row_number() OVER (PARTITION BY factor, ts ORDER BY value, symbol) AS d FROM longf WHERE value IS NOT NULL),
h AS (SELECT factor, ts, symbol, (CASE WHEN u <= 5 THEN 0.1 ELSE 0 END - CASE WHEN d <= 5 THEN 0.1 ELSE 0 END)::DOUBLE AS weight FROM f), u AS (SELECT *, lead(ts) OVER (PARTITION BY factor, symbol ORDER BY ts) AS until FROM h WHERE weight <> 0)
SELECT u.factor, strftime(u.ts, '%Y-%m-%d') AS ts, round(sum(weight * close / 1000), 6) + 0.0 AS cost FROM u JOIN panel p ON p.symbol = u.symbol AND p.ts >= u.ts AND p.ts < until GROUP BY u.factor, u.ts"""
)
def funding_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's closes, a thousandth of them, as rates."""
    rates = tables.panel(spark, sf_dir).select("symbol", "ts", (F.col("close") / 1000).alias("rate"))
    return _dated(research.funding(research.top_bottom_weights(base._factors(spark, sf_dir)[0], 5), rates))


@query(f"WITH {ORDER_PRICES} SELECT symbol, strftime(min(ts), '%Y-%m-%d') AS listed FROM history GROUP BY symbol")
def listing_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import universe

    return universe.listing_times(tables.order_prices(spark, sf_dir)).withColumn("listed", _day("listed"))


@query(
    f"""WITH {TRADES}, t AS (SELECT *, ms - ms % {_STEP} AS edge FROM trades), q AS (SELECT *, quantile_cont(quantity, 0.9) OVER (PARTITION BY symbol, edge) AS big FROM t), a AS (
  SELECT symbol, edge AS ms, sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) AS delta, count(*) FILTER (WHERE NOT is_buyer_maker) AS buy_count, count(*) FILTER (WHERE is_buyer_maker) AS sell_count,
    coalesce(sum(quantity) FILTER (WHERE quantity > big), 0) / nullif(sum(quantity), 0) AS large_trade_ratio, sum(quantity * price) FILTER (WHERE NOT is_buyer_maker) / nullif(sum(quantity) FILTER (WHERE NOT is_buyer_maker), 0) AS buy_vwap FROM q GROUP BY ALL)
SELECT symbol, ms, delta, buy_count, sell_count, round(large_trade_ratio, 6) AS large_trade_ratio, round(buy_vwap, 6) AS buy_vwap, sum(delta) OVER (PARTITION BY symbol ORDER BY ms) AS cumulative_delta FROM a"""
)
def trade_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.trade_direction(tables.trades(spark, sf_dir), _STEP), "delta", "buy_count", "sell_count", "large_trade_ratio", "buy_vwap", "cumulative_delta")


@query(f"WITH {BARS}, v AS (SELECT *, sum(dollar_volume) OVER (w ROWS 19 PRECEDING) / nullif(sum(volume) OVER (w ROWS 19 PRECEDING), 0) AS rv FROM b {_W}) SELECT symbol, {_TS}, round(rv, 6) AS rolling_vwap, round(close / rv - 1, 6) AS vwap_deviation FROM v")
def vwap_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.vwap_features(_bars(spark, sf_dir)), "rolling_vwap", "vwap_deviation")


@query(f"{_KYLE_SQL} SELECT symbol, {_TS}, round(lambda_20, 4) + 0.0 AS kyle_lambda, round((close - open) / nullif(volume, 0), 9) + 0.0 AS price_impact FROM k", 9)
def kyle_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.kyle_lambda(_with_flow(spark, sf_dir)).withColumn("kyle_lambda", F.round("kyle_lambda", 4)), "kyle_lambda", "price_impact")


_ATR_SQL = f"""WITH {BARS}, t AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM b {_W}), a AS (SELECT *, avg(tr) OVER (w ROWS 99 PRECEDING) AS atr FROM t {_W})"""


@query(f"{_ATR_SQL} SELECT symbol, {_TS}, round(atr, 6) AS atr, round(least(0.05, 0.01 * close / nullif(atr * 2, 0)), 6) AS size FROM a")
def atr_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.atr_size(_bars(spark, sf_dir)), "atr", "size")


@query(
    f"""{_ATR_SQL}, z AS (SELECT symbol, ts, least(0.05, 0.01 * close / nullif(atr * 2, 0) * CASE WHEN ofi > 0.1 THEN 0.5 WHEN ofi < -0.1 THEN 0.7 ELSE 1 END * (0.5 + abs(ofi)) * greatest(0, least(1, ofi + 1))) * CASE WHEN ofi < 0 THEN -1 ELSE 1 END AS size FROM a)
SELECT symbol, {_TS}, round(size * least(1, 0.02 / nullif(sum(abs(size)) OVER (PARTITION BY ts, sign(size)), 0)), 6) + 0.0 AS size FROM z"""
)
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled by a regime, a strength and a Kelly share made of the imbalance, then capped by side."""
    ofi = F.col("ofi")
    b = _bars(spark, sf_dir).withColumns({"regime": F.when(ofi > 0.1, "expansion").when(ofi < -0.1, "contraction").otherwise("normal"), "strength": F.abs(ofi), "kelly": ofi + 1})
    sized = research.atr_size(b).withColumn("size", F.when(ofi < 0, -F.col("size")).otherwise(F.col("size")))
    return _out(research.capped_total(sized, 0.02), "size")


@query(
    f"""WITH {BARS}, r AS (SELECT *, close - lag(close) OVER w AS d, close / lag(close) OVER w - 1 AS r1, ln(high / low) ** 2 AS hl FROM b {_W}), u AS (SELECT *, greatest(d, 0) AS up, greatest(-d, 0) AS dn FROM r), f AS (
  SELECT symbol, ts, close / avg(close) OVER v - 1 AS ps, CASE WHEN count(close) OVER v >= 2 AND stddev_samp(close) OVER v > 0 THEN (close - avg(close) OVER v) / (2 * stddev_samp(close) OVER v) END AS bb,
    avg(CASE WHEN d IS NULL THEN 0 ELSE up END) OVER v AS au, avg(CASE WHEN d IS NULL THEN 0 ELSE dn END) OVER v AS ad, sqrt(avg(hl) OVER v / (4 * ln(2))) AS pk, volume / nullif(avg(volume) OVER v, 0) AS vr, avg(abs(r1) / nullif(dollar_volume, 0)) OVER v AS am FROM u WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, {_TS}, round(am * 1e6, 4) AS amihud_20, round(ps, 6) AS price_sma_20, round(bb, 6) AS bb_pos_20, round(100 * au / nullif(au + ad, 0), 6) AS rsi_20, round(pk, 6) AS parkinson_20, round(vr, 6) AS volume_ratio_20 FROM f"""
)
def unified_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = research.unified_features(_bars(spark, sf_dir))
    return _out(made.withColumn("amihud_20", F.round(F.col("amihud_20") * 1e6, 4)), "amihud_20", "price_sma_20", "bb_pos_20", "rsi_20", "parkinson_20", "volume_ratio_20")


@query(f"WITH {BARS}, n AS (SELECT *, row_number() OVER w AS k FROM b {_W}), e AS {_ema_sql('n', 'close', 20, 'ema')} SELECT symbol, {_TS}, round(ema, 6) AS ema_20 FROM e")
def exponential_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.unified_features(_bars(spark, sf_dir)), "ema_20")


@query(
    f"""WITH {BARS}, r AS (SELECT *, stddev_samp(high) OVER v AS sh, stddev_samp(low) OVER v AS sl, covar_samp(high, low) OVER v AS cv, count(*) OVER v AS n FROM b WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 17 PRECEDING)),
c AS (SELECT *, CASE WHEN n >= 3 AND sh * sl > 1e-18 THEN cv / (sh * sl) END AS rho FROM r), t AS (SELECT *, sh / nullif(sl, 0) * rho AS beta FROM c), z AS (SELECT *, {_z_sql('beta', 60)} AS z FROM t)
SELECT symbol, {_TS}, round(beta, 4) AS rsrs_beta, round(z, 4) AS rsrs_z, round(z * rho ** 18, 4) + 0.0 AS qrs FROM z""",
    4,
)
def rsrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.rsrs(_bars(spark, sf_dir)), "rsrs_beta", "rsrs_z", "qrs")


@query(
    f"""WITH {BARS}, a AS (SELECT *, avg(close) OVER (w ROWS 12 PRECEDING) AS m13, avg(close) OVER (w ROWS 7 PRECEDING) AS m8, avg(close) OVER (w ROWS 4 PRECEDING) AS m5, avg((high - low) / 2) OVER (w ROWS 4 PRECEDING) - avg((high - low) / 2) OVER (w ROWS 33 PRECEDING) AS ao,
  lag(high) OVER w AS h1, lag(high, 2) OVER w AS h2, lag(low) OVER w AS l1, lag(low, 2) OVER w AS l2, quantile_cont(close, 0.8) OVER (w ROWS 59 PRECEDING) AS top, quantile_cont(close, 0.2) OVER (w ROWS 59 PRECEDING) AS bottom FROM b {_W})
SELECT symbol, {_TS}, round(lag(m13, 8) OVER w, 6) AS jaw, round(lag(m8, 5) OVER w, 6) AS teeth, round(lag(m5, 3) OVER w, 6) AS lips, round(ao, 9) + 0.0 AS awesome, coalesce(h1 > h2 AND h1 > high AND l1 > l2 AND l1 > low, false) AS fractal_up, coalesce(h1 < h2 AND h1 < high AND l1 < l2 AND l1 < low, false) AS fractal_down,
  CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 ELSE 0 END::BIGINT AS place_signal FROM a {_W}""",
    9,
)
def alligator(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = research.alligator(_bars(spark, sf_dir))
    return _out(made.withColumns({x: F.round(x, 6) for x in ("jaw", "teeth", "lips")}), "jaw", "teeth", "lips", "awesome", "fractal_up", "fractal_down", "place_signal")


@query(
    f"""WITH {BARS}, o AS (SELECT *, ts::DATE AS day, first_value(open) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts) AS day_open FROM b), e AS (SELECT symbol, day, lag(arg_max(close, ts)) OVER (PARTITION BY symbol ORDER BY day) AS prev FROM o GROUP BY symbol, day),
s AS (SELECT o.*, prev, avg(abs(close / day_open - 1)) OVER (PARTITION BY o.symbol, strftime(ts, '%H:%M:%S') ORDER BY ts ROWS 13 PRECEDING) AS s FROM o JOIN e ON o.symbol = e.symbol AND o.day = e.day)
SELECT symbol, {_TS}, round(day_open, 4) AS day_open, round(greatest(day_open, prev) * (1 + s), 4) AS upper, round(least(day_open, prev) * (1 - s), 4) + 0.0 AS lower FROM s""",
    4,
)
def noise_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.noise_band(_bars(spark, sf_dir)), "day_open", "upper", "lower")


@query(f"WITH {BARS}, x AS (SELECT ts, symbol < 'm' AS early, (close >= max(close) OVER v)::INT AS h, (close <= min(close) OVER v)::INT AS l FROM b WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)) SELECT {_TS}, early, round((sum(h) - sum(l)) / count(*), 6) AS net_new_highs FROM x GROUP BY ts, early")
def net_new_highs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By group: symbols of the first and of the second half of the alphabet."""
    made = research.net_new_highs(_bars(spark, sf_dir).withColumn("early", F.col("symbol") < "m"), by=("early",))
    return made.select(F.unix_millis("ts").alias("ms"), "early", "net_new_highs")


def _flip_sql(ret: str, tag: str) -> str:
    """Steps of the revised flip factor of a return, as common table expressions that end in flip_{tag}."""
    sd = f"CASE WHEN count({ret}) OVER (w ROWS 19 PRECEDING) >= 2 THEN stddev_samp({ret}) OVER (w ROWS 19 PRECEDING) END"
    return f"""s_{tag} AS (SELECT *, {sd} AS sd, avg({ret}) OVER (w ROWS 19 PRECEDING) AS mn, volume - lag(volume) OVER w AS dt FROM r {_W}),
c_{tag} AS (SELECT *, mn * sign(sd - avg(sd) OVER (PARTITION BY ts)) AS fv, {ret} * sign(dt - avg(dt) OVER (PARTITION BY ts)) AS turned FROM s_{tag}),
flip_{tag} AS (SELECT symbol, ts, fv, avg(turned) OVER (w ROWS 19 PRECEDING) AS ft FROM c_{tag} {_W})"""


_RETURNS_SQL = f"WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS ret, close / open - 1 AS intra, open / lag(close) OVER w - 1 AS night FROM b {_W})"


def _with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = research.returns(_bars(spark, sf_dir)).withColumn("turnover", F.col("volume"))
    return b.withColumns({"intra": F.try_divide("close", "open") - 1, "night": F.try_divide(F.col("open"), F.lag("close").over(rolling.ordered())) - 1})


@query(f"{_RETURNS_SQL}, {_flip_sql('ret', 'a')} SELECT symbol, {_TS}, round(fv, 6) + 0.0 AS flip_vol, round(ft, 6) + 0.0 AS flip_turn, round((fv + ft) / 2, 6) + 0.0 AS flip_revised FROM flip_a")
def flip_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.flip_factors(_with_returns(spark, sf_dir)), "flip_vol", "flip_turn", "flip_revised")


@query(
    f"""{_RETURNS_SQL}, {_flip_sql('ret', 'a')}, {_flip_sql('intra', 'b')}, {_flip_sql('night', 'c')}
SELECT symbol, {_TS}, round((a.fv + a.ft + b.fv + b.ft + c.fv + c.ft) / 2, 6) + 0.0 AS coin_team FROM flip_a a JOIN flip_b b USING (symbol, ts) JOIN flip_c c USING (symbol, ts)"""
)
def coin_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.coin_team(_with_returns(spark, sf_dir), ["ret", "intra", "night"]), "coin_team")


@query(
    f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r1, close / lag(close, 60) OVER w - 1 AS rn FROM b {_W}), p AS (SELECT *, sign(rn) * 0.4 / nullif(CASE WHEN count(r1) OVER (w ROWS 19 PRECEDING) >= 2 THEN stddev_samp(r1) OVER (w ROWS 19 PRECEDING) * sqrt(252) END, 0) AS position FROM r {_W})
SELECT symbol, {_TS}, round(position, 6) + 0.0 AS position, round(position * lead(r1) OVER w, 6) + 0.0 AS tsmom FROM p {_W}"""
)
def time_series_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.time_series_momentum(_bars(spark, sf_dir), 60, 20), "position", "tsmom")


@query(
    f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r1, close / lag(close, 20) OVER w - 1 AS rn FROM b {_W}), q AS (
  SELECT *, max(r1) OVER (w ROWS 9 PRECEDING) AS mx, CASE WHEN count(volume) OVER v >= 2 THEN stddev_samp(volume) OVER v END AS id, rn - 3000 * CASE WHEN count(r1) OVER v >= 2 THEN stddev_samp(r1) OVER v END ** 2 AS basic FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts), v AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING))
SELECT symbol, {_TS}, round((rank() OVER (PARTITION BY ts ORDER BY mx DESC) + rank() OVER (PARTITION BY ts ORDER BY id DESC) + rank() OVER (PARTITION BY ts ORDER BY basic)) / 3, 6) AS quality_momentum FROM q WHERE mx IS NOT NULL AND id IS NOT NULL AND basic IS NOT NULL"""
)
def quality_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.quality_momentum(_bars(spark, sf_dir).withColumn("turnover", F.col("volume")), 20, 10), "quality_momentum")


@query(
    f"""WITH {BARS}, r AS (SELECT *, close / lag(close) OVER w - 1 AS r1, high / low - 1 AS amp FROM b {_W}), l AS (SELECT symbol, ts, list_sort(list({{'a': amp, 'r': r1}}) FILTER (WHERE r1 IS NOT NULL AND amp IS NOT NULL) OVER (w ROWS 19 PRECEDING)) AS days FROM r {_W}),
k AS (SELECT *, (len(days) // 4)::INT AS k FROM l)
SELECT symbol, {_TS}, CASE WHEN k > 0 THEN round(list_sum(list_transform(days[1:k], lambda d: d.r)), 6) + 0.0 END AS calm_momentum, CASE WHEN k > 0 THEN round(list_sum(list_transform(days[len(days) - k + 1:], lambda d: d.r)), 6) + 0.0 END AS wild_momentum FROM k"""
)
def amplitude_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(research.amplitude_momentum(_bars(spark, sf_dir)), "calm_momentum", "wild_momentum")


_SIDES_SQL = f"""{_FACTOR_SQL}, f AS (SELECT factor, ts, symbol, row_number() OVER (PARTITION BY factor, ts ORDER BY value DESC, symbol) AS u, row_number() OVER (PARTITION BY factor, ts ORDER BY value, symbol) AS d FROM longf WHERE value IS NOT NULL),
h AS (SELECT factor, ts, symbol, (CASE WHEN u <= 5 THEN 0.1 ELSE 0 END - CASE WHEN d <= 5 THEN 0.1 ELSE 0 END)::DOUBLE AS weight FROM f)"""


@query(
    f"""{_SIDES_SQL}, r AS (SELECT ts, symbol, (100 + close / 10) / (100 + lag(close) OVER w / 10) - 1 AS r FROM panel {_W}), v AS (SELECT ts, symbol, 1 / nullif(CASE WHEN count(r) OVER x >= 2 THEN stddev_samp(r) OVER x END, 0) AS i FROM r WINDOW x AS (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING)),
j AS (SELECT * FROM h JOIN v USING (ts, symbol) WHERE weight <> 0 AND i IS NOT NULL)
SELECT factor, {_DATE}, symbol, round(i / sum(i) OVER s * sum(weight) OVER s, 6) AS weight FROM j WINDOW s AS (PARTITION BY factor, ts, sign(weight))"""
)
def risk_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, prices = base._factors(spark, sf_dir)
    return _dated(research.risk_parity(research.top_bottom_weights(f, 5), prices, 5))


@query(
    f"""{_FACTOR_SQL}, cfg AS (SELECT 'r' || a || '_p' || p || '_n' || n || '_' || w AS config, * FROM (VALUES (1), (3)) t1(a), (VALUES (0), (40)) t2(p), (VALUES (3), (10)) t3(n), (VALUES ('equal'), ('signal')) t4(w)),
rk AS (SELECT factor, ts, symbol, value, dense_rank() OVER (PARTITION BY factor ORDER BY ts) AS k FROM longf WHERE value IS NOT NULL), sz AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY volume DESC, symbol) AS size_rank FROM panel),
ev AS (SELECT config, factor, ts, symbol, value, n, w FROM rk JOIN sz USING (ts, symbol) JOIN cfg ON (k - 1) % a = 0 AND (p = 0 OR size_rank <= p)),
lg AS (SELECT *, row_number() OVER (PARTITION BY config, factor, ts ORDER BY value DESC, symbol) AS u, row_number() OVER (PARTITION BY config, factor, ts ORDER BY value, symbol) AS d, CASE WHEN w = 'signal' THEN abs(value - avg(value) OVER (PARTITION BY config, factor, ts)) ELSE 1 END AS s FROM ev),
w0 AS (SELECT config, factor, ts, symbol, s, (CASE WHEN u <= n THEN 0.5::DOUBLE / n ELSE 0 END - CASE WHEN d <= n THEN 0.5::DOUBLE / n ELSE 0 END) AS wt FROM lg),
wt AS (SELECT config || '/' || factor AS factor, ts, symbol, sum(wt) OVER g * coalesce(s / nullif(sum(s) OVER g, 0), 1::DOUBLE / count(*) OVER g) AS weight FROM w0 WHERE wt <> 0 WINDOW g AS (PARTITION BY config, factor, ts, sign(wt))),
dates AS (SELECT factor, ts, row_number() OVER (PARTITION BY factor ORDER BY ts) AS k, lead(ts) OVER (PARTITION BY factor ORDER BY ts) AS next_ts FROM (SELECT DISTINCT factor, ts FROM wt)), net AS (SELECT factor, k, symbol, weight AS w FROM wt JOIN dates USING (factor, ts)), turned AS (
  SELECT factor, k, sum(abs(d)) AS turnover FROM (SELECT factor, k, symbol, sum(w) AS d FROM (SELECT factor, k, symbol, w FROM net UNION ALL SELECT factor, k + 1, symbol, -w FROM net) GROUP BY ALL) GROUP BY ALL),
g AS (SELECT l.factor, l.ts, sum(weight * ((100 + b.close / 10) / (100 + a.close / 10) - 1)) AS gross FROM wt l JOIN dates d ON d.factor = l.factor AND d.ts = l.ts JOIN panel a ON a.ts = l.ts AND a.symbol = l.symbol JOIN panel b ON b.ts = d.next_ts AND b.symbol = l.symbol GROUP BY ALL),
p AS (SELECT d.factor, d.ts, d.next_ts, coalesce(gross, 0) AS gross, coalesce(turnover, 0) * 10 / 10000 AS cost FROM dates d LEFT JOIN g USING (factor, ts) LEFT JOIN turned USING (factor, k) WHERE next_ts IS NOT NULL),
{base._NAV_SQL}{base._PERF_TAIL} SELECT split_part(factor, '/', 1) AS config, split_part(factor, '/', 2) AS factor, round(total_return, 4) AS total_return, round(volatility, 4) AS volatility, round(max_drawdown, 4) AS max_drawdown FROM perf""",
    4,
)
def grid_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, prices = base._factors(spark, sf_dir)
    volumes = stored(tables.panel(spark, sf_dir).select("ts", "symbol", "volume"), "query-volumes")
    made = research.grid_scan(f, prices, rebalances=[1, 3], sizes=[3, 10], pools=(0, 40), weightings=("equal", "signal"), volumes=volumes)
    return made.select("config", "factor", "total_return", "volatility", "max_drawdown")


# Signals

_DIRECTION_SQL = f"""q AS (SELECT *, quantile_cont(quantity, 0.9) OVER (PARTITION BY symbol, ms - ms % {_STEP}) AS big FROM trades),
d AS (SELECT symbol, make_timestamp((ms - ms % {_STEP}) * 1000) AS ts, sum(CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END) AS delta, avg(quantity) FILTER (WHERE NOT is_buyer_maker) AS avg_buy, avg(quantity) FILTER (WHERE is_buyer_maker) AS avg_sell,
  coalesce(sum(quantity) FILTER (WHERE quantity > big), 0) / nullif(sum(quantity), 0) AS large FROM q GROUP BY ALL),
n AS (SELECT b.symbol, b.ts, ofi, tick_count / nullif(duration, 0) AS intensity, large, avg_buy, avg_sell, sum(delta) OVER w AS cd, row_number() OVER w AS k FROM b JOIN d ON b.symbol = d.symbol AND b.ts = d.ts WINDOW w AS (PARTITION BY b.symbol ORDER BY b.ts))"""


@query(
    f"""WITH {BARS}, {_DIRECTION_SQL}, e AS {_ema_sql('n', 'ofi', 10, 'ema')}, z AS (SELECT n.*, ema, cd - lag(cd, 5) OVER w AS slope, {_z_sql('intensity', 20)} AS zi, {_z_sql('large', 20)} AS zl FROM n JOIN e USING (symbol, ts) {_W}),
y AS (SELECT *, coalesce((ema > 0.02)::INT, 0) AS u1, coalesce((slope > 0)::INT, 0) AS u2, coalesce((avg_buy > avg_sell * 1.02)::INT, 0) AS u3, coalesce((-ema > 0.02)::INT, 0) AS d1, coalesce((-slope > 0)::INT, 0) AS d2, coalesce((avg_sell > avg_buy * 1.02)::INT, 0) AS d3, coalesce((zi > 0.2)::INT, 0) + coalesce((zl > 0.2)::INT, 0) AS m FROM z)
SELECT symbol, {_TS}, CASE WHEN u1 + u2 = 2 AND m + u3 >= 2 THEN 1 WHEN d1 + d2 = 2 AND m + d3 >= 2 THEN -1 ELSE 0 END::BIGINT AS signal, round(greatest(u1 + u2 + u3 + m, d1 + d2 + d3 + m) / 5, 6) AS strength FROM y"""
)
def order_flow_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With limits that the supplied events reach."""
    d = research.trade_direction(tables.trades(spark, sf_dir), _STEP)
    b = _bars(spark, sf_dir).withColumn("trade_intensity", F.try_divide("tick_count", "duration")).join(d, ["symbol", "ts"])
    return _out(research.order_flow_signal(b, flow=0.02, intensity=0.2, large=0.2, size=1.02), "signal", "strength")


@query(
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER w AS k, close / (sum(dollar_volume) OVER (w ROWS 19 PRECEDING) / nullif(sum(volume) OVER (w ROWS 19 PRECEDING), 0)) - 1 AS dev, ln(high / low) AS rv FROM b {_W}), e AS {_ema_sql('n', 'ofi', 10, 'ema')},
y AS (SELECT n.*, quantile_cont(abs(dev), 0.5) OVER (w ROWS 499 PRECEDING) AS entry, abs(ema) < 0.3 AND rv < lag(rv) OVER w AS calm, sell_volume < lag(sell_volume) OVER w AS sells, buy_volume < lag(buy_volume) OVER w AS buys FROM n JOIN e USING (symbol, ts) {_W})
SELECT symbol, {_TS}, round(entry, 6) AS entry, CASE WHEN dev < -entry AND calm AND sells THEN 1 WHEN dev > entry AND calm AND buys THEN -1 ELSE 0 END::BIGINT AS signal FROM y"""
)
def reversion_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = research.vwap_features(_bars(spark, sf_dir)).withColumn("realized_vol", F.ln(rolling.quotient("high", "low")))
    return _out(research.reversion_signal(b, share=0.5, cool=0.3, falling=2), "entry", "signal")


@query(
    f"""WITH {BARS}, v AS (SELECT *, ln(high / low) AS rv, (close - open) / nullif(volume, 0) AS pi FROM b), y AS (SELECT *, avg(rv) OVER (w ROWS 19 PRECEDING) / nullif(avg(rv) OVER (w ROWS 199 PRECEDING), 0) AS vr, duration / nullif(avg(duration) OVER (w ROWS 49 PRECEDING), 0) AS dr, {_z_sql('pi', 100)} AS z FROM v {_W}),
g AS (SELECT *, CASE WHEN vr > 3 OR z > 3 THEN 'crisis' WHEN vr > 1.05 AND dr < 1 THEN 'expansion' WHEN vr < 0.95 AND dr > 1 THEN 'contraction' WHEN vr BETWEEN 0.95 AND 1.05 THEN 'normal' END AS regime, sign(ofi) AS a, -sign(close - open) AS r FROM y)
SELECT symbol, {_TS}, regime, (CASE WHEN regime = 'crisis' THEN 0 WHEN regime = 'expansion' THEN a WHEN regime = 'contraction' THEN r WHEN a * r < 0 THEN 0 ELSE a + r END)::DOUBLE + 0.0 AS merged FROM g"""
)
def regimes_and_merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bars(spark, sf_dir).withColumns({"realized_vol": F.ln(rolling.quotient("high", "low")), "price_impact": F.try_divide(F.col("close") - F.col("open"), F.col("volume"))})
    made = research.regimes(b, high=1.05, low=0.95, quick=1.0, slow=1.0)
    merged = research.merge_signals(F.signum("ofi"), -F.signum(F.col("close") - F.col("open")), F.col("regime"))
    return _out(made.withColumn("merged", merged.cast("double")), "regime", "merged")


@query(
    f"""WITH {BARS}, z AS (SELECT *, {_z_sql('volume', 20)} AS z FROM b) SELECT symbol, {_TS}, round(CASE WHEN z > 1 THEN ofi * (1 + 0.5 * z) ELSE ofi END, 6) + 0.0 AS boosted, round(CASE WHEN z < 1 THEN 0 ELSE ofi END, 6) + 0.0 AS kept, round(CASE WHEN z > 0 THEN ofi / (1 + z) ELSE ofi END, 6) + 0.0 AS shrunk FROM z"""
)
def regime_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _bars(spark, sf_dir)
    for mode, name in (("boost", "boosted"), ("filter", "kept"), ("shrink", "shrunk")):
        made = research.regime_filter(made, "ofi", "volume", mode=mode, n=20).withColumnRenamed("filtered", name)
    return _out(made, "boosted", "kept", "shrunk")


# Without SQL: derived bar columns.
