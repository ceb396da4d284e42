"""The test tables as ticks, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import trades as tr

HOUR_US = 3_600_000_000
#: The thirty days that the events cover, in microseconds.
FIRST_US, LAST_US = 1_704_067_200_000_000, 1_706_659_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("X"), (F.col("user_id") % 2).cast("string")).alias("exchange"), F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), F.col("event_id").alias("trade_id"),
        F.col("ts").alias("trade_time"), F.col("value").alias("price"), (k + 1).cast("double").alias("quantity"), (F.col("event_id") % 2 == 1).alias("is_buyer_maker"),
    )


LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many ticks share a time here; `rank` orders them, as ids are not unique."""
    price = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("exchange"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("symbol"), F.to_date("l_shipdate").alias("date"), F.col("l_orderkey").alias("trade_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("trade_time"), price.alias("price"), F.col("l_quantity").cast("double").alias("quantity"), (F.col("l_returnflag") == "R").alias("is_buyer_maker"), F.struct(*LINE_ORDER).alias("rank"),
    )


def rank() -> Column:
    return F.col("rank")


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.prepared(event_ticks(spark, sf_dir))


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.prepared(line_ticks(spark, sf_dir), rank())


_ENRICHED = "enriched AS (SELECT *, CASE WHEN is_buyer_maker THEN -1 ELSE 1 END AS side_sign, price * quantity AS quote_abs, price * quantity * CASE WHEN is_buyer_maker THEN -1 ELSE 1 END AS quote_sign, quantity * CASE WHEN is_buyer_maker THEN -1 ELSE 1 END AS quantity_sign FROM ticks)"
_TRADES = """trades0 AS (SELECT exchange, symbol, date, trade_time, first(price ORDER BY {order}) AS price_first, last(price ORDER BY {order}) AS price_last, sum(quote_abs) AS quote_abs, sum(quote_sign) AS quote_sign,
 sum(quantity_sign) AS quantity_sign, sum(quantity) AS quantity_abs, count(*) AS num_ticks FROM enriched GROUP BY exchange, symbol, date, trade_time),
trades1 AS (SELECT *, quantity_sign >= 0 AS is_long, CASE WHEN abs(quote_abs - price_first * quantity_abs) < 1e-9 * quote_abs THEN 0.0 ELSE abs(quote_abs - price_first * quantity_abs) END AS slippage_abs FROM trades0),
trades AS (SELECT *, slippage_abs * sign(quantity_sign) AS slippage_sign, lag(price_last) OVER w AS price_last_prev, lag(trade_time) OVER w AS trade_time_prev, epoch_us(trade_time) AS trade_us, epoch_us(lag(trade_time) OVER w) AS prev_us
 FROM trades1 WINDOW w AS (PARTITION BY exchange, symbol ORDER BY trade_time))"""

EVENTS_SQL = (
    "ticks AS (SELECT 'X' || CAST(user_id % 2 AS VARCHAR) AS exchange, event_type AS symbol, CAST(ts AS DATE) AS date, event_id AS trade_id, ts AS trade_time, value AS price,"
    " CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) + 1 AS DOUBLE) AS quantity, event_id % 2 = 1 AS is_buyer_maker FROM events),\n" + _ENRICHED + ",\n" + _TRADES.format(order="trade_id")
)
LINES_SQL = (
    "ticks AS (SELECT l_linestatus AS exchange, 'S' || CAST(l_suppkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS TIMESTAMP) AS trade_time,"
    " CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS price, CAST(l_quantity AS DOUBLE) AS quantity, l_returnflag = 'R' AS is_buyer_maker, lineitem.* FROM lineitem),\n" + _ENRICHED + ",\n" + _TRADES.format(order=", ".join(LINE_ORDER))
)
BUCKETED_SQL = EVENTS_SQL + f",\nb AS (SELECT *, (trade_us + {HOUR_US - 1}) // {HOUR_US} AS b FROM trades)"
GRID_SQL = BUCKETED_SQL + ",\ngrid AS (SELECT exchange, symbol, CAST(g AS BIGINT) AS b FROM (SELECT DISTINCT exchange, symbol FROM trades), generate_series(%d, %d) AS s(g))" % (FIRST_US // HOUR_US, LAST_US // HOUR_US - 1)


def near(expression: str, digits: int = 9) -> str:
    """SQL that rounds as functions.scalar.grid_round does."""
    return f"floor(({expression}) * 1e{digits} + 0.5) / 1e{digits}"


#: Window features of grouped trades.
RETURN_SQL = "(last(price_last ORDER BY trade_us) / NULLIF(first(price_last_prev ORDER BY trade_us), 0) - 1) * 1e4"
HOLD_SQL = "(max(trade_us) - first(prev_us ORDER BY trade_us)) / 1e6"
ALPHA_SQL = "CASE WHEN min(quantity_abs) < max(quantity_abs) THEN 1 + count(*) / NULLIF(sum(ln(quantity_abs)) - count(*) * ln(min(quantity_abs)), 0) END"
FEATURES_SQL = f"""{RETURN_SQL} AS asset_return, {HOLD_SQL} AS asset_hold_time, {near("sum(quote_sign) / NULLIF(sum(quote_abs), 0)")} AS flow_imbalance, {near("sum(slippage_sign) / NULLIF(sum(slippage_abs), 0)")} AS slippage_imbalance,
 {near(ALPHA_SQL)} AS powerlaw_alpha, {near("avg(CAST(is_long AS INTEGER))")} AS share_of_long_trades, count(*) AS num_trades"""
