"""Ordered work in chunks of a series, so that no series has to be in one task.

A chunk is a stretch of grid steps, a day of the 500 ms grid by default. What a row needs from rows a few steps away comes with its chunk as a halo of copies;
what it needs from all of the series before it is carried from chunk to chunk in a table of one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grid steps of a chunk: a day of 500 ms.
STEPS = 172_800
OWN = "_chunk"


def floor_div(value: Column, by: int) -> Column:
    """Exact for integers of either sign."""
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("bigint")


def with_halo(df: DataFrame, before: int, after: int = 0, steps: int = STEPS) -> DataFrame:
    """Rows by chunk (_chunk): those of the chunk, and copies of those up to so many steps before and after it. A chunk is no shorter than its halo."""
    steps = max(steps, before, after)
    home, place = floor_div(F.col("b"), steps), F.pmod("b", F.lit(steps))
    chunks = [home, *([F.when(place >= steps - before, home + 1)] if before else []), *([F.when(place < after, home - 1)] if after else [])]
    return df.withColumns({"_home": home, OWN: F.explode(F.array_compact(F.array(*chunks)))})


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("_home") == F.col(OWN)).drop("_home", OWN)


def order(keys: tuple[str, ...], by: str = "b"):
    return Window.partitionBy(*keys, OWN).orderBy(by)


def shifted(df: DataFrame, keys: tuple[str, ...], column: str, into: str, steps: int, chunk_steps: int = STEPS) -> DataFrame:
    """Adds the value `steps` rows ahead (behind, if negative) on the dense grid of b."""
    held = with_halo(df, max(-steps, 0), max(steps, 0), chunk_steps)
    return without_halo(held.withColumn(into, F.lead(column, steps).over(order(keys))))


def filled(df: DataFrame, keys: tuple[str, ...], column: str, into: str, chunk_steps: int = STEPS) -> DataFrame:
    """Adds the last value so far; leading gaps stay. Chunks without a value hand on what came before them."""
    held = df.withColumn(OWN, floor_div(F.col("b"), chunk_steps))
    lasts = held.where(F.col(column).isNotNull()).groupBy(*keys, OWN).agg(F.max_by(column, "b").alias("_last"))
    chunks = held.select(*keys, OWN).distinct().join(lasts, [*keys, OWN], "left")
    before = Window.partitionBy(*keys).orderBy(OWN).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*keys, OWN, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = F.last(column, ignorenulls=True).over(order(keys).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_inside", inside).join(carried, [*keys, OWN]).withColumn(into, F.coalesce("_inside", "_carried")).drop("_inside", "_carried", OWN)


def ranked(df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], chunk: Column) -> DataFrame:
    """Adds _rank, from 0 in the order of by within keys, and _count, the rows of the keys. chunk: a value that never falls in that order."""
    held = df.withColumn(OWN, chunk)
    sizes = held.groupBy(*keys, OWN).agg(F.count("*").alias("_n"))
    all_of, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(OWN).rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(*keys, OWN, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(all_of).alias("_count"))
    local = held.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, OWN).orderBy(*by)) - 1)
    same = [local[k].eqNullSafe(firsts[k]) for k in (*keys, OWN)]
    return local.join(firsts, same).select(*[local[c] for c in df.columns], (F.col("_first") + F.col("_local")).alias("_rank"), "_count")
