"""Structured Streaming: tumbling candles of a tick stream. An extension; batch candles are in operators.pumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import safe_div
from tickloom.operators.trades import enrich


def candles(ticks: DataFrame, length: str = "1 hour", late: str = "10 seconds") -> DataFrame:
    """Open, close, quote, flow imbalance and ticks of each window, emitted as the watermark passes it. trade_time is a timestamp."""
    w = F.window("trade_time", length)
    rank = F.struct("trade_time", "trade_id")
    found = enrich(ticks).withWatermark("trade_time", late).groupBy("exchange", "symbol", w.alias("w")).agg(
        F.min_by("price", rank).alias("open"), F.max_by("price", rank).alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quote_abs").alias("quote_abs"), F.sum("quote_sign").alias("quote_sign"), F.count("*").alias("num_ticks"),
    )
    return found.select("exchange", "symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "quote_abs", safe_div(F.col("quote_sign"), F.col("quote_abs")).alias("flow_imbalance"), "num_ticks")
