import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import crosssection as cs
from tickloom.operators import chunks, model, panel
from tickloom.schema import VENUES, WINDOWS_MS, FeatureFilter, FeatureSet, Pair, feature_name, window_slug


def test_panel_has_the_full_set_of_regressors():
    count = lambda prefix: len(panel.panel_columns(prefix, panel.STATISTICS, WINDOWS_MS, VENUES, VENUES[0], FeatureFilter.all()))
    differences = len(WINDOWS_MS) * (len(VENUES) - 1)
    assert count("SELF") + differences == 135 and count("BTC") == count("ETH") == 63
    assert count("SELF") + differences + count("BTC") + count("ETH") + 1 == 262


def test_names_pairs_and_sets():
    assert feature_name("ETH", "asset_return", 500, "V") == "ETH-asset_return-500MS@V" and window_slug(300_000) == "300S"
    assert Pair.parse("ADA-BTC").joined == "ADABTC" and Pair.parse("ADA-BTC").name == "ADA-BTC"
    with pytest.raises(ValueError):
        Pair.parse("ADABTC")
    s = FeatureSet(("b", "a"), "y").with_regressors(["a", "c"], ["c"])
    assert s.regressors == ("b", "a", "c") and s.without({"a"}).columns == ("b", "c", "y") and s.categorical == ("c",)
    only = FeatureFilter.first(["x", "y", "z"], 2)
    assert only.allows("x") and not only.allows("z") and FeatureFilter.all().allows("z")


def test_split_cuts_truncate_the_running_share(spark):
    assert panel.split_points(100, 0.7, 0.2) == (70, 89) and panel.split_points(10, 0.7, 0.2) == (7, 9)
    for n, sizes in ((10, (7, 2, 1)), (100, (70, 19, 11))):
        df = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").alias("sampled_time"))
        got = {r["split"]: r["count"] for r in panel.chronological_split(df, 0.7, 0.2, 0.1).groupBy("split").count().collect()}
        assert (got["train"], got["validation"], got["test"]) == sizes
    with pytest.raises(ValueError):
        panel.chronological_split(df, 0.7, 0.2, 0.2)


def test_metrics(spark):
    rng = random.Random(0)
    rows = [("ab"[k % 2], rng.gauss(0, 1), rng.gauss(0, 1)) for k in range(60)] + [("c", 1.0, 1.0), ("c", 1.0, 2.0), ("d", -1.0, -1.0), ("e", None, 1.0)]
    got = {r.currency: r for r in panel.metrics(spark.createDataFrame(rows, "currency string, truth double, prediction double")).collect()}
    assert set(got) == {"ALL", "a", "b", "c", "d"}
    t = [(y, p) for c, y, p in rows if c == "a"]
    mean = sum(y for y, _ in t) / len(t)
    assert math.isclose(got["a"].R2, 1 - sum((y - p) ** 2 for y, p in t) / sum((y - mean) ** 2 for y, _ in t))
    assert (got["c"].R2, got["d"].R2, got["d"].F1, got["d"].Accuracy, got["c"].MAE) == (0.0, 1.0, 0.0, 1.0, 0.5)


def test_usable_ignores_categories_and_lead_needs_steps(spark):
    df = spark.createDataFrame([(1.0, None, 3), (1.0, 2.0, 3), (None, 2.0, 3)], "y double, x double, c int")
    assert panel.usable(df, "y", ["x", "c"], ("c",)).count() == 1
    with pytest.raises(ValueError):
        panel.lead_by(df, "x", 0, "y")


def test_average_rank_and_strategy(spark):
    df = spark.createDataFrame([(0, "a", 3.0), (0, "b", 3.0), (0, "c", 1.0)], "s int, asset string, v double")
    assert {r.asset: r["rank"] for r in df.withColumn("rank", cs.average_rank("v", ["s"])).collect()} == {"a": 1.5, "b": 1.5, "c": 3.0}
    rows = [(s, x, float((s + k) % 3), 0.01 * k) for s in range(3) for k, x in enumerate("abc")]
    got = {r.section: r for r in cs.strategy(spark.createDataFrame(rows, "section long, asset string, p double, r double"), "section", "asset", "p", "r", k=1, fee=0.5).collect()}
    assert [got[s].traded for s in range(3)] == [1, 2, 2] and math.isclose(got[0].pnl, 0.02 - 0.5)


def test_filters_and_codes(spark):
    df = spark.createDataFrame([("b", 0.0, 0.0), ("a", 0.5, 0.0), ("c", 5.0, 1.0), ("a", None, 1.0)], "k string, r double, q double")
    assert [r.r for r in cs.informative(df, ["r", "q"]).collect()] == [0.5]
    assert {(r.k, r.code) for r in cs.category_codes(df, "k", "code").collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_boosting_finds_the_informative_feature(spark):
    rng = random.Random(3)
    rows = [(rng.gauss(0, 1), rng.gauss(0, 1), rng.choice([None, 1.0])) for _ in range(400)]
    df = spark.createDataFrame([(a, b, c, 3 * a, "z") for a, b, c in rows], "`x-1@V` double, b double, c double, y double, currency string")
    fitted, best, _ = model.select_and_refit(df, ["x-1@V", "b", "c"], "y", 1, model.Boosting(trees=5, rate=0.3))
    assert best == ["x-1@V"]
    assert {r.currency: r.R2 > 0.5 for r in model.evaluate(fitted, df, best, "y", "currency").collect()} == {"ALL": True, "z": True}


def long_rows(spark):
    rows = [(s, v, 500, t, 10.0 * i + t + k, 0.1 * i + k, 0.2 * i + k, 0.3 * i + k, 2.0) for i, s in enumerate(("A", "BTC", "ETH")) for k, v in enumerate(("U", "V")) for t in (1, 2)]
    return spark.createDataFrame(rows, "symbol string, exchange string, window_ms long, sampled_time long, asset_return double, flow_imbalance double, slippage_imbalance double, share_of_long_trades double, powerlaw_alpha double")


def test_panel_values_corrected_and_compat(spark):
    ids = spark.createDataFrame([("A", 1), ("BTC", 2), ("ETH", 3)], "symbol string, currency_index long")
    build = lambda compat: {(r.symbol, r.sampled_time): r.asDict() for r in panel.build_panel(long_rows(spark), {"BTC": "BTC", "ETH": "ETH"}, (500,), ("U", "V"), "U", ids, compat=compat).collect()}
    right, old = build(False), build(True)
    assert len(right) == len(old) == 6 and set(right["A", 1]) == set(old["A", 1])
    a, b = right["A", 1], old["A", 1]
    assert a["SELF-slippage_imbalance-500MS@V"] == 1.0 and b["SELF-slippage_imbalance-500MS@V"] == 0.1 * 2 + 1
    assert a["SELF-share_of_long_trades-500MS@U"] == 0.0 and b["SELF-share_of_long_trades-500MS@U"] == 0.3 * 2
    assert a["SELF-exchange_diff-500MS@U-V"] == -1.0 and a["ETH-asset_return-500MS@U"] == b["ETH-asset_return-500MS@U"] == 21.0 and a["currency_index"] == 1


def test_splits_overrides_and_saved_models(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "t")
    assert [r["split"] for r in panel.split_at(df, F.lit(1), F.lit(3), "t").orderBy("t").collect()] == ["train", "validation", "validation", "validation", "test"]
    left, right = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int"), spark.createDataFrame([(1, 9)], "k int, b int")
    assert panel.override(left, right, ["k"]).first().asDict() == {"k": 1, "a": 2, "b": 9}
    data = spark.createDataFrame([(float(i), 2.0 * i) for i in range(30)], "x double, y double")
    fitted = model.fit(data, ["x"], "y", model.Boosting(trees=2))
    model.save(fitted, str(tmp_path / "m"))
    assert model.predict(model.load(str(tmp_path / "m")), data, ["x"]).count() == 30


def test_categories_are_split_as_sets(spark):
    """A target that depends on a category's membership, not its order."""
    rng = random.Random(4)
    rows = [(k, "abcdefgh"[k % 8], rng.gauss(0, 1)) for k in range(400)]
    df = spark.createDataFrame([(c, x, 5.0 if c in "adg" else -5.0) for _, c, x in rows], "c string, x double, y double")
    fitted = model.fit(df, ["c", "x"], "y", model.Boosting(depth=1, trees=1, rate=1.0), categorical=("c",))
    got = model.predict(fitted, df.unionByName(spark.createDataFrame([("new", 0.0, 0.0)], df.schema)), ["c", "x"], ("c",)).collect()
    assert all(abs(r.prediction - r.y) < 1e-9 for r in got if r.c != "new") and len(got) == 401
    forest = model.fit(df, ["c", "x"], "y", model.Forest(trees=5), categorical=("c",))
    assert model.evaluate(forest, df.withColumn("g", F.lit("z")), ["c", "x"], "y", "g", ("c",)).where("g = 'ALL'").first().R2 > 0.9


def test_boosting_stops_early(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.gauss(0, 1), rng.gauss(0, 1), k % 4 == 0) for k in range(300)], "x double, y double, late boolean")
    assert model.fit(df, ["x"], "y", model.Boosting(trees=60, rate=0.5), "late").stages[-1].getNumTrees < 60


def test_sweep_ranks_fits_and_writes_each_horizon(spark, tmp_path):
    rng = random.Random(5)
    rows, price = [], 100.0
    for b in range(300):
        push = rng.gauss(0, 1)
        rows.append(("X", "A", b, price, push, rng.gauss(0, 1)))
        price *= 1 + push / 100
    grid = spark.createDataFrame(rows, "exchange string, symbol string, b long, close_price double, push double, noise double")
    split = lambda df: panel.chronological_split(df, 0.7, 0.1, 0.2, ("exchange", "symbol"), ("b",))
    found, ranks = model.sweep(grid, ["push", "noise"], [1, 2], "symbol", split, model.Boosting(depth=3, trees=20, rate=0.3), 1, root=str(tmp_path))
    scores = {(r.horizon, r.symbol): r for r in found.collect()}
    assert set(scores) == {(h, s) for h in (1, 2) for s in ("A", "ALL")} and scores[1, "ALL"].R2 > 0.8 > scores[2, "ALL"].R2
    assert {(r.horizon, r.feature) for r in ranks.collect()} == {(h, f) for h in (1, 2) for f in ("push", "noise")}
    assert spark.read.option("header", True).csv(f"{tmp_path}/importances-1").orderBy(F.desc("importance")).first().feature == "push"


def test_shifts_and_splits_by_chunk_equal_those_of_whole_series(spark):
    rng = random.Random(6)
    rows = [(e, s, b, float(rng.randint(1, 99)) if rng.random() < 0.6 else None) for e in "XY" for s in "AB" for b in range(-7, 60)]
    df = spark.createDataFrame(rows, "exchange string, symbol string, b long, v double")
    value = {r[:3]: r[3] for r in rows}
    for size in (5, 16, 1000):
        for n in (3, -4):
            got = chunks.shifted(df, ("exchange", "symbol"), "v", "out", n, size).collect()
            assert len(got) == len(rows) and all(r.out == value.get((r.exchange, r.symbol, r.b + n)) for r in got)
        for r in chunks.filled(df, ("exchange", "symbol"), "v", "out", size).collect():
            seen = [value[r.exchange, r.symbol, b] for b in range(-7, r.b + 1) if value[r.exchange, r.symbol, b] is not None]
            assert r.out == (seen[-1] if seen else None)
        ranked = chunks.ranked(df, ("exchange", "symbol"), ("b",), chunks.floor_div(F.col("b"), size)).collect()
        assert all(r._rank == r.b + 7 and r._count == 67 for r in ranked) and len(ranked) == len(rows)


def test_hold_times_for_evaluation(spark):
    rows = [("V", "A", 1, 500, 1.0, 0.25), ("W", "A", 1, 500, 2.0, 0.5)]
    long = spark.createDataFrame(rows, "exchange string, symbol string, sampled_time long, window_ms long, asset_return double, asset_hold_time double")
    long = long.withColumns({c: F.lit(0.0) for c in ("flow_imbalance", "powerlaw_alpha", "slippage_imbalance", "share_of_long_trades")})
    ids = spark.createDataFrame([("A", 0)], "symbol string, currency_index int")
    out = panel.build_panel(long, {}, (500,), ("V", "W"), "V", ids, evaluation=True).first()
    assert out["SELF-asset_hold_time-500MS@V"] == 0.25 and out["SELF-exchange_diff-500MS@V-W"] == -1.0


def test_datasets_of_other_features_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    one, two = FeatureSet(("x",), "y"), FeatureSet(("x",), "y", categorical=("x",))
    assert panel.union_datasets([(df, one), (df, one)])[0].count() == 2
    with pytest.raises(ValueError):
        panel.union_datasets([(df, one), (df, two)])
    with pytest.raises(ValueError):
        panel.merge_samples([{"train": (df, one)}, {"test": (df, one)}])
