"""Right-closed, right-labelled windows on a regular grid.

Bucket b holds the trades with (b - 1) * step < t <= b * step. Overlapping windows of whole steps are built on the dense grid by a
ladder: a longer window is the merge of shorter ones a constant offset back, so all windows take one sort and a few merges a row instead of a copy of each trade for each window it falls in. A series is
worked on in chunks, each with the longest window's steps before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.bounds import Bounds
from tickloom.functions import features as ft
from tickloom.functions.scalar import from_micros
from tickloom.operators import chunks
from tickloom.operators.trades import KEYS

OUTPUTS = ("asset_return", "asset_hold_time", "flow_imbalance", "slippage_imbalance", "powerlaw_alpha", "share_of_long_trades", "num_trades")


def bucket(moment_us: Column, step_us: int) -> Column:
    """Index of the right-closed bucket: exact integer arithmetic."""
    last = moment_us + F.lit(step_us - 1)
    return ((last - F.pmod(last, F.lit(step_us))) / F.lit(step_us)).cast("bigint")


def bucketed(trades: DataFrame, step_us: int) -> DataFrame:
    """(exchange, symbol, b, p): a partial for each bucket that has trades."""
    indexed = trades.withColumn("b", bucket(F.col("trade_us"), step_us))
    return indexed.groupBy(*KEYS, "b").agg(ft.partial().alias("p"))


def grid(keys: DataFrame, first_us: int, after_us: int, step_us: int) -> DataFrame:
    """Every bucket with first_us <= label < after_us for every key."""
    low, high = -(-first_us // step_us), -(-after_us // step_us) - 1
    return keys.select(*KEYS).distinct().withColumn("b", F.explode(F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))))


def grid_of(keys: DataFrame, bounds: Bounds, step_us: int) -> DataFrame:
    """Every bucket whose label lies in the bounds: of a day at 500 ms 172,800, the first at midnight."""
    first_us, last_us = bounds.micros()
    return grid(keys, first_us, last_us + 1, step_us)


def grid_of_trades(trades: DataFrame, step_us: int) -> DataFrame:
    """The dense grid from each instrument's own first bucket to its last."""
    spans = trades.groupBy(*KEYS).agg(F.min("trade_us").alias("lo"), F.max("trade_us").alias("hi"))
    at = lambda c: bucket(F.col(c), step_us)
    return spans.select(*KEYS, F.explode(F.sequence(at("lo"), at("hi"))).alias("b"))


def tumbling(trades: DataFrame, step_us: int) -> DataFrame:
    """Features of each bucket that has trades."""
    return finalize(bucketed(trades, step_us), "p", step_us, step_us)


def finalize(df: DataFrame, column: str, step_us: int, window_us: int, names: tuple[str, ...] = OUTPUTS, compat: bool = False) -> DataFrame:
    """Features of a partial, with the label as sampled_time and the return scaled by hold time; compat gives the returns as older stores hold them."""
    p = F.col(column)
    out = df.select(*KEYS, "b", from_micros(F.col("b") * step_us).alias("sampled_time"), *[ft.FEATURES[n](p).alias(n) for n in names])
    if {"asset_return", "asset_hold_time"} <= set(names):
        plain, hold = F.col("asset_return"), F.col("asset_hold_time")
        first, second = ft.compat_returns(plain, hold, window_us / 1e6) if compat else (plain, ft.adjusted_return(plain, hold, window_us / 1e6))
        out = out.withColumns({"asset_return": first, "asset_return_adj": second})
    return out


def with_edges(df: DataFrame, window_us: int) -> DataFrame:
    """Adds window_start (not in the window) and window_end (in it) to rows with a sampled_time."""
    return df.withColumn("window_end", F.col("sampled_time")).withColumn("window_start", F.col("sampled_time") - F.expr(f"make_dt_interval(0, 0, 0, {window_us / 1e6!r})"))


def rungs(lengths: list[int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each length in steps, and doublings on the way, the (shorter length, steps back) that add up to it."""
    built, out = [1], []

    def build(k: int) -> None:
        parts, back = [], 0
        while back < k:
            part = max(x for x in built if x <= k - back)
            parts.append((part, back))
            back += part
        built.append(k)
        out.append((k, parts))

    for k in sorted(set(lengths)):
        if k < 1:
            raise ValueError("windows are whole steps")
        while 2 * max(built) < k:
            build(2 * max(built))
        if k not in built:
            build(k)
    return out


def overlapping(trades: DataFrame, step_us: int, lengths: list[int], dense: DataFrame | None = None, warmup: str = "partial", chunk_steps: int = chunks.STEPS) -> DataFrame:
    """(exchange, symbol, b, w1, wK...): on each grid row, the partial of the last K steps for every K of lengths.

    warmup="drop" empties windows that begin before the instrument's first trade's step; "partial" keeps what they have. Trades outside the grid don't
    count: begin it earlier to have them. Each key's grid has no gaps.
    """
    if warmup not in ("partial", "drop"):
        raise ValueError(warmup)
    dense = grid_of_trades(trades, step_us) if dense is None else dense
    longest = max(lengths) - 1
    found = bucketed(trades, step_us)
    joined = dense.join(found, [*KEYS, "b"], "left").withColumn("w1", F.coalesce("p", ft.empty())).drop("p")
    df = chunks.without_halo(_with_rungs(chunks.with_halo(joined, longest, steps=chunk_steps), lengths))
    if warmup == "drop":
        firsts = found.groupBy(*KEYS).agg(F.min("b").alias("_b0"))
        df = df.join(firsts, list(KEYS), "left")
        df = df.withColumns({f"w{k}": F.when(F.col("b") < F.col("_b0") - 1 + k, ft.empty()).otherwise(F.col(f"w{k}")) for k in sorted({1, *lengths})}).drop("_b0")
    return df.select(*KEYS, "b", *[f"w{k}" for k in sorted(set(lengths))])


def _with_rungs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds the rungs to w1, by chunk. The grid is dense, so a lag of rows is one of steps."""
    order = chunks.order(KEYS)
    for k, parts in rungs(lengths):
        pieces = [F.coalesce(F.lag(f"w{n}", back).over(order), ft.empty()) if back else F.col(f"w{n}") for n, back in parts]
        names = [f"_m{i}" for i in range(len(pieces))]
        df = df.withColumns(dict(zip(names, pieces, strict=True)))
        merged = F.col(names[0])
        for name in names[1:]:
            merged = ft.merge(F.col(name), merged)
        df = df.withColumn(f"w{k}", merged).drop(*names)
    return df


def naive_overlapping(trades: DataFrame, step_us: int, length: int) -> DataFrame:
    """The same for one length by copying trades into every window: a check for small inputs. Windows without trades are absent."""
    copies = trades.withColumn("b", F.explode(F.sequence(bucket(F.col("trade_us"), step_us), bucket(F.col("trade_us"), step_us) + F.lit(length - 1))))
    return copies.groupBy(*KEYS, "b").agg(ft.partial().alias(f"w{length}"))


def forward_fill(df: DataFrame, column: str, into: str, chunk_steps: int = chunks.STEPS) -> DataFrame:
    """Adds the last value so far; leading gaps stay."""
    return chunks.filled(df, KEYS, column, into, chunk_steps)


def sampled(trades: DataFrame, step_us: int, lengths: list[int], first_us: int, after_us: int, warmup: str = "partial", chunk_steps: int = chunks.STEPS) -> DataFrame:
    """Long table of all windows on the grid [first_us, after_us): returns are 0 where missing, the close is carried forward."""
    dense = grid(trades, first_us, after_us, step_us)
    wide = overlapping(trades, step_us, sorted({1, *lengths}), dense, warmup, chunk_steps)
    closed = forward_fill(wide.withColumn("_close", F.col("w1")["last_price"]), "_close", "close_price", chunk_steps)
    stacked = closed.select(*KEYS, "b", "close_price", F.explode(F.array(*[F.struct(F.lit(k).alias("length"), F.col(f"w{k}").alias("p")) for k in lengths])).alias("x"))
    p, seconds = F.col("x.p"), F.col("x.length") * step_us / 1e6
    out = stacked.select(*KEYS, "b", from_micros(F.col("b") * step_us).alias("sampled_time"), (F.col("x.length") * step_us / 1000).cast("bigint").alias("window_ms"), "close_price", seconds.alias("_s"), *[ft.FEATURES[n](p).alias(n) for n in OUTPUTS])
    out = out.withColumn("asset_return_adj", F.col("asset_return") * F.try_divide(F.col("_s"), F.col("asset_hold_time"))).drop("_s")
    return out.withColumn("asset_return", F.coalesce("asset_return", F.lit(0.0)))
