"""Window features as mergeable partials.

A partial of a set of trades is a struct; merging the partials of an older and a newer set gives the partial of both. A feature is a
function of a partial. New features need an entry in FEATURES, and in the three functions below if the partial lacks what they need.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom.functions.scalar import bps, safe_div

_SUMS = ("n", "quote_abs", "quote_sign", "slip_abs", "slip_sign", "longs", "ln_q")
_ENDS = ("first_prev", "first_prev_us", "last_price", "last_us")

PARTIAL = "struct<n:bigint,quote_abs:double,quote_sign:double,slip_abs:double,slip_sign:double,longs:bigint,ln_q:double,price:double,price_m2:double,min_q:double,max_q:double,first_prev:double,first_prev_us:bigint,last_price:double,last_us:bigint>"


def partial() -> Column:
    """Aggregate of trades (quote_abs, quote_sign, slippage_abs, slippage_sign, is_long, quantity_abs, price_last, price_last_prev, trade_us, prev_us)."""
    first, last = F.col("trade_us"), F.col("trade_us")
    return F.struct(
        F.count(F.lit(1)).alias("n"), F.sum("quote_abs").alias("quote_abs"), F.sum("quote_sign").alias("quote_sign"), F.sum("slippage_abs").alias("slip_abs"), F.sum("slippage_sign").alias("slip_sign"),
        F.sum(F.col("is_long").cast("bigint")).alias("longs"), F.sum(F.ln("quantity_abs")).alias("ln_q"), F.avg("price_last").alias("price"), (F.var_pop("price_last") * F.count("price_last")).alias("price_m2"),
        F.min("quantity_abs").alias("min_q"), F.max("quantity_abs").alias("max_q"), F.min_by("price_last_prev", first).alias("first_prev"), F.min_by("prev_us", first).alias("first_prev_us"),
        F.max_by("price_last", last).alias("last_price"), F.max("trade_us").alias("last_us"),
    )


def empty() -> Column:
    return F.expr(f"cast(named_struct('n', 0L, 'quote_abs', 0d, 'quote_sign', 0d, 'slip_abs', 0d, 'slip_sign', 0d, 'longs', 0L, 'ln_q', 0d, 'price', 0d, 'price_m2', 0d, 'min_q', null, 'max_q', null, 'first_prev', null, 'first_prev_us', null, 'last_price', null, 'last_us', null) as {PARTIAL})")


def merge(older: Column, newer: Column) -> Column:
    """A first value may be a legitimate NULL, so it is taken from the oldest set that has trades, not coalesced."""
    out = [(older[x] + newer[x]).alias(x) for x in _SUMS]
    # Mean and sum of squared deviations of the prices: squares of large prices would cancel.
    n = F.greatest(older["n"] + newer["n"], F.lit(1))
    apart = newer["price"] - older["price"]
    mean = F.when(older["n"] == 0, newer["price"]).otherwise(older["price"] + apart * newer["n"] / n)
    out += [mean.alias("price"), (older["price_m2"] + newer["price_m2"] + apart * apart * older["n"] * newer["n"] / n).alias("price_m2")]
    out += [F.least(older["min_q"], newer["min_q"]).alias("min_q"), F.greatest(older["max_q"], newer["max_q"]).alias("max_q")]
    out += [F.when(older["n"] > 0, older[x]).otherwise(newer[x]).alias(x) for x in _ENDS[:2]]
    out += [F.when(newer["n"] > 0, newer[x]).otherwise(older[x]).alias(x) for x in _ENDS[2:]]
    return F.struct(*out)


def _alpha(p: Column) -> Column:
    """Hill-type tail exponent; NULL when all quantities are equal."""
    return F.when(p["min_q"] < p["max_q"], 1 + safe_div(p["n"], p["ln_q"] - p["n"] * F.ln(p["min_q"])))


def _sigma(p: Column) -> Column:
    """Sample deviation of the trades' last prices."""
    return F.when(p["n"] > 1, F.sqrt(p["price_m2"] / F.greatest(p["n"] - 1, F.lit(1))))


FEATURES: dict[str, Callable[[Column], Column]] = {
    "asset_return": lambda p: bps(p["last_price"], p["first_prev"]),
    "asset_hold_time": lambda p: (p["last_us"] - p["first_prev_us"]) / 1e6,
    "flow_imbalance": lambda p: safe_div(p["quote_sign"], p["quote_abs"]),
    "slippage_imbalance": lambda p: safe_div(p["slip_sign"], p["slip_abs"]),
    "powerlaw_alpha": _alpha,
    "share_of_long_trades": lambda p: safe_div(p["longs"], p["n"]),
    "num_trades": lambda p: p["n"],
    "close_price": lambda p: p["last_price"],
    "sigma": _sigma,
}


def adjusted_return(asset_return: Column, hold_seconds: Column, window_seconds: float) -> Column:
    """A return scaled to the window by the time the asset was held."""
    return asset_return * safe_div(F.lit(window_seconds), hold_seconds)


def ratio_score(value: Column, deviation: Column) -> Column:
    """Mean over deviation, not demeaned."""
    return safe_div(F.avg(value), deviation)


def compat_returns(asset_return: Column, hold_seconds: Column, window_seconds: float) -> tuple[Column, Column]:
    """(asset_return, asset_return_adj) as older stores hold them: scaled once and twice."""
    once = adjusted_return(asset_return, hold_seconds, window_seconds)
    return once, adjusted_return(once, hold_seconds, window_seconds)
