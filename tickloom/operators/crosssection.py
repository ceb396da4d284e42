"""Cross-sectional analytics, importances and the portfolio strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import safe_div

FEE = 0.1 * 0.00075


def average_rank(value: str, by: list[str], descending: bool = True) -> Column:
    """Rank within by, ties sharing the mean of their places."""
    order = F.col(value).desc() if descending else F.col(value).asc()
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def zscore(value: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return safe_div(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w))


def section_ids(df: DataFrame, start: str, end: str) -> DataFrame:
    """Adds section_id: the ordinal of (start, end). Numbered on the few distinct sections, not on the rows."""
    sections = df.select(start, end).distinct()
    numbered = sections.withColumn("section_id", F.row_number().over(Window.orderBy(start, end)) - 1)
    return df.join(numbered, [start, end])


def category_codes(df: DataFrame, name: str, out: str) -> DataFrame:
    """Adds the alphabetical ordinal of a column's value."""
    numbered = df.select(name).distinct().withColumn(out, F.row_number().over(Window.orderBy(name)) - 1)
    return df.join(numbered, name)


def drop_first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k > 1").drop("_k")


def informative(df: DataFrame, returns: list[str], limit: float = 1.0) -> DataFrame:
    """Rows whose returns are not all 0 and whose first return lies within the limits; a missing one is not within."""
    nonzero = F.lit(False)
    for c in returns:
        nonzero = nonzero | (F.coalesce(F.col(c), F.lit(1.0)) != 0)
    return df.where(nonzero & F.col(returns[0]).between(-limit, limit))


def strategy(df: DataFrame, section: str, asset: str, prediction: str, realised: str, k: int = 10, fee: float = FEE) -> DataFrame:
    """Per section: mean realised return of the k assets with the best predictions, less a fee for each asset bought or sold since the section before.

    section must be a dense ordinal. Ties go to the alphabetically first asset.
    """
    order = Window.partitionBy(section).orderBy(F.col(prediction).desc(), F.col(asset))
    top = df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k)
    held = top.groupBy(section).agg(F.avg(realised).alias("gross"), F.array_sort(F.collect_set(asset)).alias("held"))
    before = held.select((F.col(section) + 1).alias(section), F.col("held").alias("before"))
    joined = held.join(before, section, "left").withColumn("before", F.coalesce("before", F.expr("cast(array() as array<string>)")))
    traded = F.size(F.array_except("held", "before")) + F.size(F.array_except("before", "held"))
    return joined.select(section, F.col("gross"), traded.alias("traded"), (F.col("gross") - traded * fee).alias("pnl"))


def cumulative(df: DataFrame, value: str, order: str, by: list[str] | None = None) -> Column:
    w = Window.partitionBy(*(by or [])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(w)


def top_k(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(value), tie).limit(k)


def last_k(df: DataFrame, value: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(value, F.desc(tie)).limit(k)


def pivot_normalised(df: DataFrame, feature: str, horizon: str, gain: str, horizons: list) -> DataFrame:
    """Gains by feature and horizon, 0 where absent, each horizon as shares of its total, with their mean; largest mean first."""
    total = F.sum(gain).over(Window.partitionBy(horizon))
    shares = df.groupBy(feature, horizon).agg(F.sum(gain).alias(gain)).withColumn("_share", safe_div(F.col(gain), total))
    wide = shares.groupBy(feature).pivot(horizon, horizons).agg(F.sum("_share")).na.fill(0.0)
    wide = wide.select(feature, *[F.col(f"`{h}`").alias(f"h{h}") for h in horizons])
    mean = sum((F.col(f"h{h}") for h in horizons[1:]), F.col(f"h{horizons[0]}")) / len(horizons)
    return wide.withColumn("mean_share", mean).orderBy(F.desc("mean_share"), feature)


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column: rows, missing values, least, largest and mean."""
    sums = df.agg(*[F.struct(F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("missing"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("largest"), F.avg(c).alias("mean")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{c}.{x}").alias(x) for x in ("n", "missing", "least", "largest", "mean")]) for c in columns])).alias("x")).select("x.*")
