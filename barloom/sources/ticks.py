"""Readers and writers of ticks, quotes, bars, factors and reports.

Trades are (symbol, ts, trade_id, price, quantity, is_buyer_maker); quotes are
(symbol, ts, best_bid_price, best_bid_qty, best_ask_price, best_ask_qty). Rows
without a time, and trades without price or quantity, are dropped; a missing
maker flag counts as a taker's buy. Stored tables are partitioned by symbol and
month, so a symbol list or a span of months prunes files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import Store

# Raw column names, in order, of the venues' files.
SPOT_TRADE_COLUMNS = ("agg_trade_id", "price", "quantity", "first_trade_id", "last_trade_id", "timestamp", "is_buyer_maker", "is_best_match")
FUTURES_TRADE_COLUMNS = SPOT_TRADE_COLUMNS[:7]
SIDE_TRADE_COLUMNS = ("trade_id", "price", "size", "side", "timestamp")
QUOTE_COLUMNS = ("update_id", "best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty", "transaction_time", "event_time")


def as_time(c: Column, kind: T.DataType | None = None, unit: str = "ms") -> Column:
    """A timestamp from a number of ``unit`` (s, ms, us, ns) or from any time type."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType)):
        return c.cast("timestamp")
    micros = {"s": c * 1_000_000, "ms": c * 1_000, "us": c, "ns": F.floor(c / 1_000)}[unit]
    return F.timestamp_micros(micros.cast("long"))


def millis(c: Column) -> Column:
    return F.unix_millis(c)


def finite(c: Column) -> Column:
    """The number, or null for NaN and infinities."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def trades(raw: DataFrame, *, symbol: Column, ts: Column, trade_id: Column, price: Column, quantity: Column, maker: Column) -> DataFrame:
    """The trade columns with the null rules applied."""
    made = raw.select(symbol.alias("symbol"), ts.alias("ts"), trade_id.cast("long").alias("trade_id"), finite(price).alias("price"), finite(quantity).alias("quantity"), F.coalesce(maker.cast("boolean"), F.lit(False)).alias("is_buyer_maker"))
    return made.filter("ts is not null and price is not null and quantity is not null")


def quotes(raw: DataFrame, *, symbol: Column, ts: Column, bid: Column, bid_qty: Column, ask: Column, ask_qty: Column) -> DataFrame:
    made = raw.select(symbol.alias("symbol"), ts.alias("ts"), finite(bid).alias("best_bid_price"), finite(bid_qty).alias("best_bid_qty"), finite(ask).alias("best_ask_price"), finite(ask_qty).alias("best_ask_qty"))
    return made.filter("ts is not null and best_bid_price is not null and best_ask_price is not null")


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...], header: bool) -> DataFrame:
    return spark.read.csv(path, header=header, schema=T.StructType([T.StructField(c, T.StringType()) for c in columns]))


def _number(name: str, kind: str = "double") -> Column:
    return F.expr(f"try_cast({name} as {kind})")


def normalize_maker_trades(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """Spot and futures trade files, which carry a maker flag and milliseconds."""
    return trades(raw, symbol=F.lit(symbol), ts=as_time(_number("timestamp", "bigint")), trade_id=_number("agg_trade_id", "bigint"), price=_number("price"), quantity=_number("quantity"), maker=F.lower("is_buyer_maker").isin("true", "1"))


def normalize_side_trades(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """Trade files that name the taker's side: a sell has a buyer as maker."""
    return trades(raw, symbol=F.lit(symbol), ts=as_time(_number("timestamp", "bigint")), trade_id=_number("trade_id", "bigint"), price=_number("price"), quantity=_number("size"), maker=F.lower("side") == "sell")


def normalize_quotes(raw: DataFrame, symbol: str | Column) -> DataFrame:
    """Best-quote files; the transaction time is the time."""
    return quotes(raw, symbol=F.lit(symbol), ts=as_time(_number("transaction_time", "bigint")), bid=_number("best_bid_price"), bid_qty=_number("best_bid_qty"), ask=_number("best_ask_price"), ask_qty=_number("best_ask_qty"))


def read_trade_csv(spark: SparkSession, path: str, symbol: str | Column, *, side_based: bool = False, header: bool = False) -> DataFrame:
    columns = SIDE_TRADE_COLUMNS if side_based else SPOT_TRADE_COLUMNS
    raw = _csv(spark, path, columns, header)
    return normalize_side_trades(raw, symbol) if side_based else normalize_maker_trades(raw, symbol)


def read_quote_csv(spark: SparkSession, path: str, symbol: str | Column, *, header: bool = False) -> DataFrame:
    return normalize_quotes(_csv(spark, path, QUOTE_COLUMNS, header), symbol)


def csv_to_parquet(spark: SparkSession, pattern: str, out: str, columns: tuple[str, ...], *, header: bool = False) -> None:
    """Bulk conversion of raw files, columns kept as they are."""
    _csv(spark, pattern, columns, header).write.mode("overwrite").option("compression", "zstd").parquet(out)


def replace_partitions(df: DataFrame, keys: tuple[str, ...], path: str, fmt: str = "parquet", **options) -> None:
    """Writes ``df`` by ``keys``: the partitions it has rows of are replaced, all others
    stay. Files are moved into place when all tasks are done, so a run that fails leaves the
    old ones and one that is repeated changes nothing. A large partition gets several files."""
    writer = df.hint("rebalance", *keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd" if fmt == "parquet" else "none").options(**options).partitionBy(*keys).format(fmt).save(path)


def write_ticks(ticks: DataFrame, path: str) -> None:
    """By symbol and month; a symbol's month is replaced as a whole."""
    replace_partitions(ticks.withColumn("month", F.date_format("ts", "yyyy-MM")), ("symbol", "month"), path)


def read_ticks(spark: SparkSession, path: str, *, symbols: list[str] | None = None, start_month: str | None = None, end_month: str | None = None) -> DataFrame:
    """Stored trades or quotes; months are inclusive and prune partitions, months without files are absent."""
    df = spark.read.parquet(path)
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(symbols))
    if start_month:
        df = df.filter(F.col("month").cast("string") >= start_month)
    if end_month:
        df = df.filter(F.col("month").cast("string") <= end_month)
    return df


def dedup(ticks: DataFrame) -> DataFrame:
    """One row per symbol and trade_id."""
    return ticks.dropDuplicates(["symbol", "trade_id"])


def write_bars(bars: DataFrame, path: str) -> None:
    """Complete bars by symbol and month of their end (time bars carry ``month``); a
    symbol's month is replaced as a whole. Beside them, under ``_incomplete`` of the same
    name, the open bars by symbol: a symbol's latest replace the one before. The bars are
    computed once."""
    if "month" not in bars.columns:
        bars = bars.withColumn("month", F.date_format(F.timestamp_millis("end_time_ms"), "yyyy-MM"))
    if "is_complete" not in bars.columns:
        bars = bars.withColumn("is_complete", F.lit(True))
    with Store(bars.sparkSession) as store:
        made = store(bars, "bars")
        replace_partitions(made.filter("is_complete").drop("is_complete"), ("symbol", "month"), path)
        replace_partitions(made.filter("not is_complete").drop("is_complete"), ("symbol",), f"{path.rstrip('/')}_incomplete")


def load_panel(spark: SparkSession, path: str, *, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Stored bars in long form: (ts, symbol, columns...), ts being the bar's start."""
    df = spark.read.parquet(path).withColumn("ts", F.timestamp_millis("start_time_ms"))
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(symbols))
    if start:
        df = df.filter((F.col("month").cast("string") >= start[:7]) & (F.col("ts") >= F.lit(start).cast("timestamp")))
    if end:
        df = df.filter((F.col("month").cast("string") <= end[:7]) & (F.col("ts") <= F.lit(end).cast("timestamp")))
    return df.select("ts", "symbol", *columns) if columns else df


def symbols_of(df: DataFrame) -> DataFrame:
    return df.select("symbol").distinct().orderBy("symbol")


def date_ranges(df: DataFrame) -> DataFrame:
    """First and last time and number of rows of each symbol."""
    return df.groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n_rows"))


def preview(df: DataFrame, *, symbol: str | None = None, columns: list[str] | None = None, n: int = 10) -> DataFrame:
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    order = [c for c in ("ts", "start_time_ms", "symbol", "trade_id") if c in df.columns]
    return df.orderBy(*order).select(*(columns or df.columns)).limit(n)


def coverage_gaps(present: DataFrame, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """(symbol, month) that should be there and aren't: each symbol's months from
    ``start`` (or its listing, its first time) to ``end`` (or the last time of all)."""
    last = present.agg(F.max("ts").alias("last_ts"))
    first = present.groupBy("symbol").agg(F.min("ts").alias("first_ts")).crossJoin(F.broadcast(last))  # one row
    begin = F.greatest(F.lit(start).cast("timestamp"), F.col("first_ts")) if start else F.col("first_ts")
    stop = F.lit(end).cast("timestamp") if end else F.col("last_ts")
    months = F.explode(F.sequence(F.trunc(begin, "MM"), F.trunc(stop, "MM"), F.expr("interval 1 month")))
    wanted = first.filter(F.trunc(begin, "MM") <= F.trunc(stop, "MM")).select("symbol", months.alias("m")).select("symbol", F.date_format("m", "yyyy-MM").alias("month"))
    there = present.select("symbol", F.date_format("ts", "yyyy-MM").alias("month")).distinct()
    return wanted.join(there, ["symbol", "month"], "left_anti")


def write_factors(factors: DataFrame, path: str, fmt: str = "parquet") -> None:
    """(factor, ts, symbol, value) by factor and month; a factor's month is replaced as a whole."""
    replace_partitions(factors.withColumn("month", F.date_format("ts", "yyyy-MM")), ("factor", "month"), path, fmt, header=True)


def read_factors(spark: SparkSession, path: str, names: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.format(fmt).options(header=True)
    df = (reader if fmt == "parquet" else reader.schema("ts timestamp, symbol string, value double, factor string, month string")).load(path)
    return (df.filter(F.col("factor").isin(names)) if names else df).select("factor", "ts", "symbol", "value")


def write_report(tables: dict[str, DataFrame], folder: str) -> None:
    """Each result table as CSV with a header, under its name."""
    for name, table in tables.items():
        table.write.mode("overwrite").csv(f"{folder.rstrip('/')}/{name}", header=True)
