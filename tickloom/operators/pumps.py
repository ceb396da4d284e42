"""Cross-sections around events: look-back features and forward targets of every instrument at every event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions import features as ft
from tickloom.functions.scalar import bps, safe_div

HOUR = 3_600_000_000
MINUTE = 60_000_000
DAY = 24 * HOUR
#: Look-back windows and target windows in microseconds. Fixed values.
LOOKBACKS = {"1MIN": MINUTE, "2MIN": 2 * MINUTE, "5MIN": 5 * MINUTE, "15MIN": 15 * MINUTE, "1H": HOUR, "2H": 2 * HOUR, "4H": 4 * HOUR, "12H": 12 * HOUR, "1D": DAY, "2D": 2 * DAY, "7D": 7 * DAY, "14D": 14 * DAY}
TARGETS = {f"{k}MIN": k * MINUTE for k in range(1, 6)}


def hourly_candles(trades: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Left-closed, left-labelled hours of prepared trades: return in bps from the price before the first trade, quote, long quote, slippage, trades."""
    keyed = trades.withColumn("hour_us", F.col("trade_us") - F.pmod("trade_us", F.lit(HOUR)))
    return keyed.groupBy(*extra, "exchange", "symbol", "hour_us").agg(
        bps(F.max_by("price_last", "trade_us"), F.min_by("price_last_prev", "trade_us")).alias("asset_return"), F.sum("quote_abs").alias("quote_abs"),
        F.sum(F.when(F.col("is_long"), F.col("quote_abs")).otherwise(0.0)).alias("quote_long"), F.sum("slippage_abs").alias("slippage"), F.count("*").alias("num_trades"),
    )


def near_events(trades: DataFrame, events: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """Trades within reach of events (event, event_us), once for each such event.

    An equi-join on hours of time, whatever the number of events: an event stands in every hour it reaches, a trade in its own.
    """
    slot = HOUR
    reach = events.withColumn("_slot", F.explode(F.sequence(F.expr(f"(event_us - {before_us}) div {slot}"), F.expr(f"(event_us + {after_us}) div {slot}"))))
    dealt = trades.withColumn("_slot", F.expr(f"trade_us div {slot}"))
    return dealt.join(reach, "_slot").where((F.col("trade_us") >= F.col("event_us") - before_us) & (F.col("trade_us") <= F.col("event_us") + after_us)).drop("_slot")


def cross_sections(trades: DataFrame, events: DataFrame, lookbacks: dict[str, int] | None = None, targets: dict[str, int] | None = None, gap_us: int = HOUR, before_us: int = 30 * DAY, after_us: int = HOUR) -> DataFrame:
    """A row for each event and instrument.

    Look-backs are [event - gap - W, event - gap], targets [event, event + W], both closed. Deviations are over all trades in reach,
    the event's own hour included, as the feature is defined. The two scores read hourly candles by their left label.
    """
    lookbacks, targets = lookbacks or LOOKBACKS, targets or TARGETS
    near = near_events(trades, events, before_us, after_us)
    keys = ["event", "exchange", "symbol"]
    hours = hourly_candles(near.withColumn("_e", F.struct("event", "event_us")), ("_e",)).select("exchange", "symbol", F.col("_e.event").alias("event"), F.col("_e.event_us").alias("event_us"), "hour_us", "asset_return", "quote_abs")
    rb = F.col("event_us") - gap_us
    inside = lambda c, w: (F.col(c) >= rb - w) & (F.col(c) <= rb)
    scored = hours.groupBy(*keys).agg(
        F.stddev_samp("asset_return").alias("_sr"), F.stddev_samp("quote_abs").alias("_sq"),
        *[F.avg(F.when(inside("hour_us", w), F.col(c))).alias(f"_{c}@{n}") for n, w in lookbacks.items() for c in ("asset_return", "quote_abs")],
    )

    def window(condition) -> dict:
        pick = lambda c: F.when(condition, F.col(c))
        q = pick("quantity_abs")
        n, low = F.count(q), F.min(q)
        alpha = F.when(low < F.max(q), 1 + safe_div(n, F.sum(F.ln(q)) - n * F.ln(low)))
        first = F.min_by("price_last_prev", pick("trade_us"))
        return {
            "asset_return": bps(F.max_by("price_last", pick("trade_us")), F.when(n > 0, first)), "share_of_long_trades": F.avg(pick("is_long").cast("double")), "powerlaw_alpha": alpha,
            "slippage_imbalance": safe_div(F.sum(pick("slippage_sign")), F.sum(pick("slippage_abs"))), "flow_imbalance": safe_div(F.sum(pick("quote_sign")), F.sum(pick("quote_abs"))), "num_trades": n,
        }

    columns = [c.alias(f"{f}@{n}") for n, w in lookbacks.items() for f, c in window(inside("trade_us", w)).items()]
    columns += [window((F.col("trade_us") >= F.col("event_us")) & (F.col("trade_us") <= F.col("event_us") + w))["asset_return"].alias(f"target_return@{n}") for n, w in targets.items()]
    out = near.groupBy(*keys).agg(*columns).join(scored, keys)
    for n in lookbacks:
        out = out.withColumns({f"asset_return_zscore@{n}": safe_div(F.col(f"`_asset_return@{n}`"), F.col("_sr")), f"quote_abs_zscore@{n}": safe_div(F.col(f"`_quote_abs@{n}`"), F.col("_sq"))})
    return out.drop("_sr", "_sq", *[f"_{c}@{n}" for n in lookbacks for c in ("asset_return", "quote_abs")])


def offset_scores(candles: DataFrame, at_us: int, offsets: dict[str, int]) -> DataFrame:
    """Demeaned scores and deviation ratios of hourly returns in the offsets before at_us, against all hours before it."""
    past = candles.where(F.col("hour_us") < at_us)
    mean, spread = F.avg("asset_return"), F.stddev_samp("asset_return")
    columns = []
    for n, w in offsets.items():
        recent = F.when(F.col("hour_us") >= at_us - w, F.col("asset_return"))
        columns += [safe_div(F.avg(recent) - mean, spread).alias(f"zscore_{n}"), safe_div(F.stddev_samp(recent), spread).alias(f"std_ratio_{n}")]
    return past.groupBy("exchange", "symbol").agg(*columns, ft.ratio_score(F.col("quote_abs"), F.stddev_samp("quote_abs")).alias("quote_ratio"))


def interval_log_return(trades: DataFrame, end_us: int, offset_us: int) -> DataFrame:
    """ln(last / first price) of each instrument's trades in [end, end + offset]."""
    inside = trades.where(F.col("trade_us").between(end_us, end_us + offset_us))
    return inside.groupBy("exchange", "symbol").agg(F.ln(safe_div(F.max_by("price_last", "trade_us"), F.min_by("price_last", "trade_us"))).alias("log_return"))
