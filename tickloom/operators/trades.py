"""Ticks and trades: from raw prints to one row per instrument and time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import maker_sign, micros

KEYS = ("exchange", "symbol")


def maker_side() -> Column:
    return maker_sign(F.col("is_buyer_maker"))


def enrich(ticks: DataFrame, side: Callable[[], Column] = maker_side) -> DataFrame:
    """Adds side_sign, quote_abs, quote_sign and quantity_sign; side gives the sign of a tick."""
    quote = F.col("price") * F.col("quantity")
    return ticks.withColumns({"side_sign": side(), "quote_abs": quote}).withColumns({"quote_sign": F.col("quote_abs") * F.col("side_sign"), "quantity_sign": F.col("quantity") * F.col("side_sign")})


def aggregate(ticks: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per exchange, symbol, date and trade_time of enriched ticks; `order` ranks the ticks of one time (default trade_id)."""
    rank = F.col("trade_id") if order is None else order
    return (
        ticks.withColumn("_rank", rank)
        .groupBy(*KEYS, "date", "trade_time")
        .agg(
            F.min_by("price", "_rank").alias("price_first"), F.max_by("price", "_rank").alias("price_last"), F.sum("quote_abs").alias("quote_abs"), F.sum("quote_sign").alias("quote_sign"),
            F.sum("quantity_sign").alias("quantity_sign"), F.sum("quantity").alias("quantity_abs"), F.count("*").alias("num_ticks"),
        )
        .withColumn("is_long", F.col("quantity_sign") >= 0)
    )


def slippage(trades: DataFrame, dust: float = 1e-9) -> DataFrame:
    """Adds slippage_abs and slippage_sign. What is under dust times the quote is rounding, and 0."""
    raw = F.abs(F.col("quote_abs") - F.col("price_first") * F.col("quantity_abs"))
    return trades.withColumn("slippage_abs", F.when(raw < dust * F.col("quote_abs"), 0.0).otherwise(raw)).withColumn("slippage_sign", F.col("slippage_abs") * F.signum("quantity_sign"))


def previous(trades: DataFrame, chunk: str = "continuous") -> DataFrame:
    """Adds price_last_prev and trade_time_prev of an instrument's trade before; with chunk="day" the first of a day has none."""
    if chunk not in ("continuous", "day"):
        raise ValueError(chunk)
    day = Window.partitionBy(*KEYS, "date").orderBy("trade_time")
    out = trades.withColumns({"price_last_prev": F.lag("price_last").over(day), "trade_time_prev": F.lag("trade_time").over(day)})
    if chunk == "day":
        return out
    # A day's first trade follows the last one of the day before that has trades: one row a day, whatever the day holds.
    lasts = trades.groupBy(*KEYS, "date").agg(F.max_by("price_last", "trade_time").alias("price"), F.max("trade_time").alias("at"))
    days = Window.partitionBy(*KEYS).orderBy("date")
    carried = lasts.select(*KEYS, "date", F.lag("price").over(days).alias("_price"), F.lag("at").over(days).alias("_at"))
    first, names = F.col("trade_time_prev").isNull(), out.columns
    out = out.join(carried, [*KEYS, "date"], "left").withColumns({"price_last_prev": F.when(first, F.col("_price")).otherwise(F.col("price_last_prev")), "trade_time_prev": F.coalesce("trade_time_prev", "_at")})
    return out.select(*names)


def prepared(ticks: DataFrame, order: Column | None = None, side: Callable[[], Column] = maker_side, chunk: str = "continuous") -> DataFrame:
    """Ticks to trades with slippage, previous trade, and both times in microseconds (trade_us, prev_us)."""
    out = previous(slippage(aggregate(enrich(ticks, side), order)), chunk)
    return out.withColumns({"trade_us": micros(F.col("trade_time")), "prev_us": micros(F.col("trade_time_prev"))})
