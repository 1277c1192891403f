"""The supplied tables seen as ticks, quotes and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: the type is the symbol, the value the price."""
    e = table(spark, sf_dir, "events")
    return ticks.trades(e, symbol=F.col("event_type"), ts=F.col("ts").cast("timestamp"), trade_id=F.col("event_id"), price=F.col("value"), quantity=F.col("event_id") % 7, maker=F.col("user_id") % 2 == 0)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    spread = F.get_json_object("props", "$.k").cast("double") / 100
    size = 1 + F.col("event_id") % 5
    return ticks.quotes(e, symbol=F.col("event_type"), ts=F.col("ts").cast("timestamp"), bid=F.col("value"), bid_qty=size, ask=F.col("value") + spread, ask_qty=size)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily (ts, symbol, close, volume): a user is a symbol."""
    e = table(spark, sf_dir, "events").filter("value is not null and ts is not null")
    return e.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), F.col("user_id").alias("symbol")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"), F.sum(F.col("event_id") % 7).cast("double").alias("volume"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long daily history (ts, symbol, close, dollar_volume): an order priority is a symbol."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("symbol")).agg(F.max_by("o_totalprice", "o_orderkey").alias("close"), F.sum("o_totalprice").alias("dollar_volume"))


#: The same views in DuckDB SQL, as common table expressions.
TRADES = """trades AS (
  SELECT event_type AS symbol, ts, epoch_us(ts) // 1000 AS ms, event_id AS trade_id, value AS price, (event_id % 7)::DOUBLE AS quantity, user_id % 2 = 0 AS is_buyer_maker
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""
QUOTES = """quotes AS (
  SELECT event_type AS symbol, ts, epoch_us(ts) // 1000 AS ms, event_id, value AS bid, value + (json_extract_string(props, '$.k'))::DOUBLE / 100 AS ask
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL)"""
PANEL = """panel AS (
  SELECT date_trunc('day', ts) AS ts, user_id AS symbol, arg_max(value, (ts, event_id)) AS close, sum(event_id % 7)::DOUBLE AS volume
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL)"""
ORDER_PRICES = """history AS (
  SELECT o_orderdate::TIMESTAMP AS ts, o_orderpriority AS symbol, arg_max(o_totalprice, o_orderkey) AS close, sum(o_totalprice) AS dollar_volume
  FROM orders GROUP BY ALL)"""
