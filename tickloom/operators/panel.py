"""Wide panels: features by instrument, venue and window, market features, targets, splits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import bps, safe_div
from tickloom.operators import chunks
from tickloom.operators.trades import KEYS
from tickloom.schema import FeatureFilter, FeatureSet, difference_name, feature_name

#: Which statistics are read for which venues, and whether market instruments carry them too.
STATISTICS = (
    ("asset_return", "target", True),
    ("flow_imbalance", "all", True),
    ("powerlaw_alpha", "all", True),
    ("slippage_imbalance", "all", False),
    ("share_of_long_trades", "all", False),
)


def panel_columns(prefix: str, statistics: tuple, windows_ms: tuple[int, ...], venues: tuple[str, ...], target_venue: str, allow: FeatureFilter) -> list[tuple[str, str, int, str]]:
    """(name, statistic, window, venue) of each allowed column of a prefix; SELF has all statistics, market prefixes those marked."""
    out = []
    for statistic, where, market in statistics:
        if prefix != "SELF" and not market:
            continue
        for window in windows_ms:
            for venue in (target_venue,) if where == "target" else venues:
                name = feature_name(prefix, statistic, window, venue)
                if allow.allows(name):
                    out.append((name, statistic, window, venue))
    return out


def widen(long: DataFrame, keys: list[str], columns: list[tuple[str, str, int, str]], more: list[Column] | None = None) -> DataFrame:
    """One row per keys from rows per (keys, window_ms, exchange): a conditional aggregate for each column, one shuffle for all. more: further aggregates."""
    picked = [F.max(F.when((F.col("window_ms") == w) & (F.col("exchange") == v), F.col(s))).alias(name) for name, s, w, v in columns]
    return long.groupBy(*keys).agg(*picked, *(more or []))


def difference_columns(target_venue: str, others: tuple[str, ...], windows_ms: tuple[int, ...], prefix: str = "SELF", allow: FeatureFilter | None = None) -> list[Column]:
    """Aggregates for the return on the target venue less that on each other."""
    allow = allow or FeatureFilter.all()
    value = lambda w, v: F.max(F.when((F.col("window_ms") == w) & (F.col("exchange") == v), F.col("asset_return")))
    return [(value(w, target_venue) - value(w, o)).alias(n) for w in windows_ms for o in others if allow.allows(n := difference_name(prefix, w, target_venue, o))]


def exchange_differences(long: DataFrame, target_venue: str, others: tuple[str, ...], windows_ms: tuple[int, ...], prefix: str = "SELF", allow: FeatureFilter | None = None) -> DataFrame:
    """Return on the target venue less that on each other, by symbol and time."""
    return long.groupBy("symbol", "sampled_time").agg(*difference_columns(target_venue, others, windows_ms, prefix, allow))


def with_market(panel: DataFrame, long: DataFrame, markets: dict[str, str], windows_ms: tuple[int, ...], venues: tuple[str, ...], target_venue: str, allow: FeatureFilter | None = None) -> DataFrame:
    """Attaches to every row the market instruments' features of the same time. markets: prefix to symbol."""
    allow, out = allow or FeatureFilter.all(), panel
    for prefix, symbol in markets.items():
        columns = panel_columns(prefix, STATISTICS, windows_ms, venues, target_venue, allow)
        if columns:
            out = out.join(widen(long.where(F.col("symbol") == symbol), ["sampled_time"], columns), "sampled_time", "left")
    return out


def hold_times(windows_ms: tuple[int, ...], target_venue: str, prefix: str = "SELF") -> list[tuple[str, str, int, str]]:
    """Columns of the hold times on the target venue: for evaluation, not regressors."""
    return [(feature_name(prefix, "asset_hold_time", w, target_venue), "asset_hold_time", w, target_venue) for w in windows_ms]


def build_panel(
    long: DataFrame, markets: dict[str, str], windows_ms: tuple[int, ...], venues: tuple[str, ...], target_venue: str, ids: DataFrame, allow: FeatureFilter | None = None, compat: bool = False, evaluation: bool = False
) -> DataFrame:
    """SELF, market and difference columns with the categorical currency_index of ids (symbol, currency_index).

    evaluation adds the hold times on the target venue. compat repeats what older panels hold: slippage columns have the flow imbalance, and the SELF columns
    that market instruments lack have the last market's values.
    """
    allow = allow or FeatureFilter.all()
    if compat:
        long = long.withColumn("slippage_imbalance", F.col("flow_imbalance"))
    columns = panel_columns("SELF", STATISTICS, windows_ms, venues, target_venue, allow)
    alone = [c for c in columns if not dict((s, m) for s, _, m in STATISTICS)[c[1]]] if compat else []
    held = [c for c in columns if c not in alone] + (hold_times(windows_ms, target_venue) if evaluation else [])
    others = tuple(v for v in venues if v != target_venue)
    if compat:
        last = [*markets.values()][-1]
        of_last = long.where(F.col("symbol") == last)
        wide = widen(long, ["symbol", "sampled_time"], held).join(widen(of_last, ["sampled_time"], alone, difference_columns(target_venue, others, windows_ms, allow=allow)), "sampled_time", "left")
    else:
        wide = widen(long, ["symbol", "sampled_time"], held, difference_columns(target_venue, others, windows_ms, allow=allow))
    wide = with_market(wide, long, markets, windows_ms, venues, target_venue, allow)
    return wide.join(ids.select("symbol", F.col("currency_index").cast("int").alias("currency_index")), "symbol")


def lead_by(df: DataFrame, column: str, steps: int, into: str, chunk_steps: int = chunks.STEPS) -> DataFrame:
    """Adds the value `steps` grid rows ahead (behind, if negative); 0 is refused as it leaks nothing and shifts nothing."""
    if steps == 0:
        raise ValueError("steps must not be 0")
    return chunks.shifted(df, KEYS, column, into, steps, chunk_steps)


def forward_return(df: DataFrame, steps: int, close: str = "close_price", chunk_steps: int = chunks.STEPS) -> DataFrame:
    """Adds output: the change of the close over the next steps of the dense grid, in basis points."""
    ahead = lead_by(df, close, steps, "_ahead", chunk_steps)
    return ahead.withColumn("output", bps(F.col("_ahead"), F.col(close))).drop("_ahead")


def usable(df: DataFrame, target: str, regressors: list[str], categorical: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a target and with at least one regressor that is not a category."""
    return df.dropna(subset=[target]).dropna(how="all", subset=[r for r in regressors if r not in categorical])


def split_points(n: int, train: float, validation: float) -> tuple[int, int]:
    """Rows before the first and before the second cut; the running share is truncated as a float product."""
    return int(n * train), int(n * (train + validation))


def chronological_split(df: DataFrame, train: float, validation: float = 0.0, test: float = 0.0, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("sampled_time",)) -> DataFrame:
    """Adds split: train, validation and test in order of time within each group. Ranks are counted by chunk: days of a time, chunks.STEPS of a number."""
    if abs(train + validation + test - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    first = df.schema[order[0]].dataType.typeName()
    chunk = F.to_date(order[0]) if first.startswith(("timestamp", "date")) else F.floor(F.col(order[0]) / F.lit(chunks.STEPS))
    ranked = chunks.ranked(df, by, order, chunk)
    n, k = F.col("_count").cast("double"), F.col("_rank")
    cut = lambda share: F.floor(n * F.lit(float(share)))
    return ranked.withColumn("split", F.when(k < cut(train), "train").when(k < cut(train + validation), "validation").otherwise("test")).drop("_rank", "_count")


def split_at(df: DataFrame, first: Column, second: Column, moment: str) -> DataFrame:
    """Adds split by two times: train before the first, validation from it to the second, both included, test after."""
    t = F.col(moment)
    return df.withColumn("split", F.when(t < first, "train").when(t <= second, "validation").otherwise("test"))


def union_datasets(parts: list[tuple[DataFrame, FeatureSet]]) -> tuple[DataFrame, FeatureSet]:
    """Rows of datasets with the same features, of their columns only; other feature sets are refused."""
    features = parts[0][1]
    if any(f != features for _, f in parts):
        raise ValueError("datasets have different features")
    return functools.reduce(DataFrame.unionByName, [df.select(*[F.col(f"`{c}`") for c in features.columns]) for df, _ in parts]), features


def merge_samples(samples: list[dict[str, tuple[DataFrame, FeatureSet]]]) -> dict[str, tuple[DataFrame, FeatureSet]]:
    """Samples (split to dataset) merged split by split; each has the same splits."""
    if any(set(s) != set(samples[0]) for s in samples):
        raise ValueError("samples have different splits")
    return {split: union_datasets([s[split] for s in samples]) for split in samples[0]}


def override(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of both by keys; of columns that both have, the right's."""
    return left.drop(*[c for c in right.columns if c not in keys]).join(right, keys, "left")


def metrics(df: DataFrame, by: str = "currency", truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """R2, MAE, F1 and Accuracy of each group and of ALL, in one pass. Signs are compared by being above 0; without positives F1 is 0."""
    t, p = F.col("_t"), F.col("_p")
    up, said = t > 0, p > 0
    base = df.select(F.col(by).cast("string").alias("_g"), F.col(truth).cast("double").alias("_t"), F.col(prediction).cast("double").alias("_p")).dropna(subset=["_t", "_p"])
    sums = base.groupingSets([[], ["_g"]], "_g").agg(
        F.grouping("_g").alias("all"), F.count("*").alias("n"), F.sum((t - p) * (t - p)).alias("sse"), F.sum(F.abs(t - p)).alias("sae"), F.var_pop("_t").alias("var"),
        F.sum((up & said).cast("int")).alias("tp"), F.sum((up & ~said).cast("int")).alias("fn"), F.sum((~up & said).cast("int")).alias("fp"), F.sum((up == said).cast("int")).alias("hits"),
    )
    sst = F.col("var") * F.col("n")
    r2 = F.when(sst > 0, 1 - F.col("sse") / F.when(sst > 0, sst)).when(F.col("n") > 0, F.when(F.col("sse") == 0, 1.0).otherwise(0.0))
    f1 = F.coalesce(safe_div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fn") + F.col("fp")), F.lit(0.0))
    named = F.when(F.col("all") == 1, "ALL").otherwise(F.col("_g"))
    return sums.where("n > 0").select(named.alias(by), r2.alias("R2"), safe_div(F.col("sae"), F.col("n")).alias("MAE"), f1.alias("F1"), safe_div(F.col("hits"), F.col("n")).alias("Accuracy"))
