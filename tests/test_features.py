import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.bounds import Bounds
from tickloom.functions.scalar import clip, epoch_to_time, keep_finite, side_sign
from tickloom.operators import trades as tr
from tickloom.operators import windows as w

DAY = datetime(2024, 1, 1)
HALF = 500_000
BASE = 1_704_067_200_000_000


def ticks(spark, rows):
    data = [("X", "A", DAY.date(), i, DAY + timedelta(milliseconds=t), float(p), float(q), m) for i, t, p, q, m in rows]
    return spark.createDataFrame(data, "exchange string, symbol string, date date, trade_id long, trade_time timestamp_ntz, price double, quantity double, is_buyer_maker boolean")


MICRO = [(1, 100, 10, 2, False), (2, 100, 11, 1, False), (3, 500, 12, 1, True), (4, 501, 12, 4, False), (5, 1700, 6, 2, True)]


def test_trades_of_the_micro_fixture(spark):
    rows = tr.prepared(ticks(spark, MICRO)).orderBy("trade_time").collect()
    assert [(r.price_first, r.price_last, r.quote_abs, r.quote_sign, r.quantity_sign, r.quantity_abs, r.num_ticks, r.is_long, r.slippage_abs, r.slippage_sign, r.price_last_prev) for r in rows] == [
        (10, 11, 31, 31, 3, 3, 2, True, 1, 1, None), (12, 12, 12, -12, -1, 1, 1, False, 0, 0, 11), (12, 12, 48, 48, 4, 4, 1, True, 0, 0, 12), (6, 6, 12, -12, -2, 2, 1, False, 0, 0, 12),
    ]


def at(df, length, label):
    return next(r for r in df if r.window_ms == length * 500 and r.sampled_time == DAY + timedelta(seconds=label))


def test_windows_of_the_micro_fixture(spark):
    trades = tr.prepared(ticks(spark, MICRO))
    for warmup, steps in (("partial", 172_800), ("drop", 172_800), ("partial", 2), ("drop", 2)):
        rows = w.sampled(trades, HALF, [1, 2], BASE + HALF, BASE + 2_000_000 + HALF, warmup, chunk_steps=steps).collect()
        assert len(rows) == 8
        a = at(rows, 1, 0.5)
        assert (a.asset_return, a.asset_hold_time, a.slippage_imbalance, a.share_of_long_trades, a.close_price) == (0, None, 1, 0.5, 12)
        assert math.isclose(a.flow_imbalance, 19 / 43) and math.isclose(a.powerlaw_alpha, 1 + 2 / math.log(3))
        b = at(rows, 1, 1.0)
        assert (b.asset_return, b.asset_hold_time, b.flow_imbalance, b.slippage_imbalance, b.powerlaw_alpha) == (0, 0.001, 1, None, None)
        c = at(rows, 1, 1.5)
        assert (c.asset_return, c.asset_hold_time, c.num_trades, c.close_price) == (0, None, 0, 12)
        d = at(rows, 1, 2.0)
        assert (d.asset_return, d.asset_hold_time, d.flow_imbalance, d.close_price) == (-5000, 1.199, -1, 6)
        assert math.isclose(d.asset_return_adj, -2085.070892, abs_tol=1e-5)
        assert at(rows, 2, 0.5).num_trades == (2 if warmup == "partial" else 0)
        e = at(rows, 2, 1.0)
        assert math.isclose(e.flow_imbalance, 67 / 91) and math.isclose(e.share_of_long_trades, 2 / 3)


def random_trades(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice([500 * rng.randint(0, 240), rng.randint(0, 120_000)]), rng.randint(1, 64) / 4, rng.randint(1, 32) / 2, rng.random() < 0.5) for i in range(n)]
    return tr.prepared(ticks(spark, rows))


@pytest.mark.parametrize("length", [1, 2, 4, 10, 60])
def test_ladder_equals_copies(spark, length):
    trades = random_trades(spark, length).cache()
    dense = w.grid(trades, BASE, BASE + 150_500_000, HALF)
    ladder = w.overlapping(trades, HALF, [1, 2, 4, 10, 60], dense, chunk_steps=70).select("b", F.col(f"w{length}").alias("p")).where("p.n > 0")
    naive = w.naive_overlapping(trades, HALF, length).select("b", F.col(f"w{length}").alias("p"))
    fields = lambda df: {r.b: (r.p.n, r.p.quote_abs, r.p.quote_sign, r.p.longs, r.p.min_q, r.p.max_q, r.p.first_prev, r.p.first_prev_us, r.p.last_price, r.p.last_us, round(r.p.ln_q, 9)) for r in df.collect()}
    assert fields(ladder) == fields(naive)


def test_rungs_add_up():
    for lengths in ([1, 2, 4, 10, 20, 60, 120, 240, 600], [7], [1], [3, 1000]):
        for k, parts in w.rungs(lengths):
            assert sum(n for n, _ in parts) == k and [b for _, b in parts] == [sum(n for n, _ in parts[:i]) for i in range(len(parts))]
    assert sum(len(p) - 1 for _, p in w.rungs([1, 2, 4, 10, 20, 60, 120, 240, 600])) < 20


def test_later_ticks_do_not_change_earlier_rows(spark):
    base = [(i, 250 * i, 10 + i % 7, 1 + i % 3, i % 2 == 0) for i in range(80)]
    changed = [(i, t, p * (3 if t > 10_000 else 1), q, m if t <= 10_000 else not m) for i, t, p, q, m in base]
    rows = lambda x: {(r.window_ms, r.b): r for r in w.sampled(tr.prepared(ticks(spark, x)), HALF, [1, 4, 20], BASE, BASE + 20_000_000).where(F.col("sampled_time") <= DAY + timedelta(seconds=10)).collect()}
    assert rows(base) == rows(changed)


def test_scalars(spark):
    row = spark.range(1).select(
        side_sign(F.lit("SELL")).alias("a"), side_sign(F.lit("sell")).alias("b"), side_sign(F.lit(None).cast("string")).alias("c"), clip(F.lit(None).cast("double"), 1, 2).alias("d"), clip(F.lit(9.0), 1, 2).alias("e"),
        keep_finite(F.lit(float("inf"))).alias("f"), epoch_to_time(F.lit(1735603200000), F.lit("2024-12-31").cast("date")).alias("g"), epoch_to_time(F.lit(1735776000000000), F.lit("2025-01-02").cast("date")).alias("h"),
    ).first()
    assert tuple(row) == (-1, 1, 1, None, 2.0, None, datetime(2024, 12, 31), datetime(2025, 1, 2))


def test_compat_returns_and_edges(spark):
    trades = tr.prepared(ticks(spark, MICRO))
    row = w.with_edges(w.finalize(w.bucketed(trades, HALF), "p", HALF, HALF, compat=True), HALF).where("asset_hold_time > 1").first()
    assert math.isclose(row.asset_return, -2085.070892, abs_tol=1e-5) and math.isclose(row.asset_return_adj, -869.504125, abs_tol=1e-5)
    assert (row.window_start, row.window_end) == (DAY + timedelta(seconds=1.5), DAY + timedelta(seconds=2))


def test_grid_of_a_day_has_every_label_from_midnight(spark):
    keys = spark.createDataFrame([("X", "A")], "exchange string, symbol string")
    day = w.grid_of(keys, Bounds.for_day(DAY.date()), HALF)
    ends = day.agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi")).first()
    assert ends.n == 172_800 and ends.lo * HALF == BASE and (ends.hi + 1) * HALF == BASE + 86_400_000_000


def test_deviation_of_large_prices_keeps_its_digits(spark):
    rows = [(k, 100 * k, 60_000_000 + 0.25 * (k % 3), 1, False) for k in range(40)]
    out = w.finalize(w.overlapping(tr.prepared(ticks(spark, rows)), HALF, [4]), "w4", HALF, 4 * HALF, ("sigma", "num_trades"))
    for r in out.where("num_trades = 20").collect():
        last = (r.b * HALF - BASE) // 100_000
        prices = [0.25 * (k % 3) for k in range(last - 19, last + 1)]
        mean = sum(prices) / 20
        assert math.isclose(r.sigma, math.sqrt(sum((p - mean) ** 2 for p in prices) / 19), rel_tol=1e-6)


def test_previous_trade_across_days(spark):
    data = [("X", "A", (DAY + timedelta(days=d)).date(), 10 * d + k, DAY + timedelta(days=d, hours=k), float(10 * d + k), 1.0, False) for d in (0, 1, 4) for k in (1, 2)]
    trades = tr.aggregate(tr.enrich(spark.createDataFrame(data, "exchange string, symbol string, date date, trade_id long, trade_time timestamp_ntz, price double, quantity double, is_buyer_maker boolean")))
    assert [r.price_last_prev for r in tr.previous(trades).orderBy("trade_time").collect()] == [None, 1.0, 2.0, 11.0, 12.0, 41.0]
    assert [r.price_last_prev for r in tr.previous(trades, "day").orderBy("trade_time").collect()] == [None, 1.0, None, 11.0, None, 41.0]


def test_windows_hash_and_chunk(spark):
    """No sort-based aggregation of trades, and no window over a whole series."""
    trades = tr.prepared(ticks(spark, MICRO))
    plan = w.sampled(trades, HALF, [1, 4], BASE, BASE + 10_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
