"""The dimension of instruments, and samples of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.crosssection import category_codes
from tickloom.schema import STABLECOINS


def instruments(symbols: DataFrame, stable: tuple[str, ...] = STABLECOINS) -> DataFrame:
    """(symbol, base, term, is_stable, currency_index) of the distinct symbols BASE-TERM; other symbols have no base or term. Indices follow the names."""
    parts = F.split("symbol", "-")
    whole = F.size(parts) == 2
    named = symbols.select("symbol").where("symbol is not null").distinct().withColumns({"base": F.when(whole, F.get(parts, F.lit(0))), "term": F.when(whole, F.get(parts, F.lit(1)))})
    marked = named.withColumn("is_stable", F.coalesce(F.col("base").isin(*stable), F.lit(False)))
    return category_codes(marked, "symbol", "currency_index")


def targets(dimension: DataFrame) -> DataFrame:
    """Instruments that a forecast may aim at: those whose base isn't a stablecoin."""
    return dimension.where("not is_stable")


def sample_rows(df: DataFrame, keys: list[str], share: float, seed: int = 0) -> DataFrame:
    """About `share` of the rows, chosen by a digest of their keys: the same rows in every run and for every partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(share * (1 << 32)))
