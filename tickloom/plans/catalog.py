"""Registered queries of the tick engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.bounds import Bounds
from tickloom.functions.features import adjusted_return
from tickloom.functions.scalar import clip, epoch_to_time, from_micros, grid_round, keep_finite, safe_div, side_sign
from tickloom.operators import crosssection as cs
from tickloom.operators import instruments, model, panel, pumps, windows
from tickloom.operators import trades as tr
from tickloom.plans import adapters as ad
from tickloom.plans.adapters import BUCKETED_SQL, EVENTS_SQL, FEATURES_SQL, FIRST_US, GRID_SQL, HOUR_US, LAST_US, LINES_SQL, RETURN_SQL, near, table
from tickloom.schema import FeatureSet
from tickloom.sources import ingest, scratch
from tickloom.streaming.candles import candles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with the SQL that DuckDB answers alike."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: grid_round(F.col(f"`{n}`"), digits) for n in names})


RATIOS = ("flow_imbalance", "slippage_imbalance", "powerlaw_alpha", "share_of_long_trades")


@query(f"WITH {EVENTS_SQL} SELECT exchange, symbol, trade_id, trade_time, side_sign, quote_abs, quote_sign, quantity_sign FROM enriched")
def ticks_enriched(spark, sf):
    return tr.enrich(ad.event_ticks(spark, sf)).select("exchange", "symbol", "trade_id", "trade_time", "side_sign", "quote_abs", "quote_sign", "quantity_sign")


@query(f"WITH {LINES_SQL} SELECT exchange, symbol, date, trade_time, price_first, price_last, {near('quote_abs', 4)} AS quote_abs, {near('quote_sign', 4)} AS quote_sign, quantity_sign, quantity_abs, num_ticks, is_long FROM trades")
def trades_agg(spark, sf):
    out = tr.aggregate(tr.enrich(ad.line_ticks(spark, sf)), ad.rank())
    return rounded(out, "quote_abs", "quote_sign", digits=4)


@query(f"WITH {LINES_SQL} SELECT exchange, symbol, trade_time, {near('slippage_abs', 4)} AS slippage_abs, {near('slippage_sign', 4)} AS slippage_sign FROM trades")
def trade_slippage(spark, sf):
    out = tr.slippage(tr.aggregate(tr.enrich(ad.line_ticks(spark, sf)), ad.rank()))
    return rounded(out.select("exchange", "symbol", "trade_time", "slippage_abs", "slippage_sign"), "slippage_abs", "slippage_sign", digits=4)


@query(f"WITH {EVENTS_SQL} SELECT exchange, symbol, trade_time, price_last, price_last_prev, trade_time_prev FROM trades")
def trade_lags(spark, sf):
    return ad.event_trades(spark, sf).select("exchange", "symbol", "trade_time", "price_last", "price_last_prev", "trade_time_prev")


@query(
    f"WITH {EVENTS_SQL} SELECT exchange, symbol, trade_us - trade_us % {HOUR_US} AS hour_us, {RETURN_SQL} AS asset_return, {near('sum(quote_abs)', 4)} AS quote_abs,"
    f" {near('sum(CASE WHEN is_long THEN quote_abs ELSE 0.0 END)', 4)} AS quote_long, {near('sum(slippage_abs)', 4)} AS slippage, count(*) AS num_trades FROM trades GROUP BY exchange, symbol, hour_us"
)
def candles_hourly(spark, sf):
    return rounded(pumps.hourly_candles(ad.event_trades(spark, sf)), "quote_abs", "quote_long", "slippage", digits=4)


@query(f"WITH {BUCKETED_SQL}, f AS (SELECT exchange, symbol, b, {FEATURES_SQL} FROM b GROUP BY exchange, symbol, b) SELECT *, make_timestamp(b * {HOUR_US}) AS sampled_time, asset_return * (3600.0 / NULLIF(asset_hold_time, 0)) AS asset_return_adj FROM f")
def window_features_tumbling(spark, sf):
    return rounded(windows.tumbling(ad.event_trades(spark, sf), HOUR_US), *RATIOS)


def _overlap(length: int) -> None:
    sql = f"WITH {GRID_SQL} SELECT g.exchange, g.symbol, g.b, {FEATURES_SQL} FROM (SELECT exchange, symbol, b FROM grid) g JOIN b USING (exchange, symbol) WHERE b.b > g.b - {length} AND b.b <= g.b GROUP BY g.exchange, g.symbol, g.b"

    def f(spark, sf):
        trades = ad.event_trades(spark, sf)
        dense = windows.grid(trades, FIRST_US, LAST_US, HOUR_US)
        wide = windows.overlapping(trades, HOUR_US, [length], dense).where(F.col(f"w{length}.n") > 0)
        return rounded(windows.finalize(wide, f"w{length}", HOUR_US, length * HOUR_US), *RATIOS).drop("sampled_time", "asset_return_adj")

    f.__name__ = f"window_features_overlap_{length}h"
    query(sql)(f)


for _length in (2, 6, 24):
    _overlap(_length)


@query(f"WITH {GRID_SQL}, f AS (SELECT exchange, symbol, b, {FEATURES_SQL} FROM b GROUP BY exchange, symbol, b) SELECT g.exchange, g.symbol, g.b, coalesce(f.asset_return, 0.0) AS asset_return, f.flow_imbalance, f.num_trades FROM grid g LEFT JOIN f USING (exchange, symbol, b)")
def grid_left_join_fill(spark, sf):
    trades = ad.event_trades(spark, sf)
    found = windows.tumbling(trades, HOUR_US).select("exchange", "symbol", "b", "asset_return", "flow_imbalance", "num_trades")
    joined = windows.grid(trades, FIRST_US, LAST_US, HOUR_US).join(found, ["exchange", "symbol", "b"], "left")
    return rounded(joined.withColumn("asset_return", F.coalesce("asset_return", F.lit(0.0))), "flow_imbalance")


CLOSE_SQL = GRID_SQL + ",\nc AS (SELECT g.exchange, g.symbol, g.b, last_value(x.close IGNORE NULLS) OVER (PARTITION BY g.exchange, g.symbol ORDER BY g.b ROWS UNBOUNDED PRECEDING) AS close_price FROM grid g LEFT JOIN (SELECT exchange, symbol, b, last(price_last ORDER BY trade_us) AS close FROM b GROUP BY exchange, symbol, b) x USING (exchange, symbol, b))"


def _closes(spark, sf):
    trades = ad.event_trades(spark, sf)
    found = windows.bucketed(trades, HOUR_US).select("exchange", "symbol", "b", F.col("p.last_price").alias("close"))
    dense = windows.grid(trades, FIRST_US, LAST_US, HOUR_US).join(found, ["exchange", "symbol", "b"], "left")
    return windows.forward_fill(dense, "close", "close_price").drop("close")


@query(f"WITH {CLOSE_SQL} SELECT * FROM c")
def close_ffill(spark, sf):
    return _closes(spark, sf)


@query(f"WITH {BUCKETED_SQL}, f AS (SELECT exchange, symbol, b, {FEATURES_SQL} FROM b GROUP BY exchange, symbol, b) SELECT exchange, symbol, b, asset_return, asset_return * (3600.0 / NULLIF(asset_hold_time, 0)) AS asset_return_adj FROM f")
def return_adj(spark, sf):
    out = windows.tumbling(ad.event_trades(spark, sf), HOUR_US)
    return out.select("exchange", "symbol", "b", "asset_return", adjusted_return(F.col("asset_return"), F.col("asset_hold_time"), 3600.0).alias("asset_return_adj"))


@query(f"WITH {BUCKETED_SQL} SELECT exchange, symbol, b, {near('stddev_samp(price_last)', 4)} AS sigma FROM b GROUP BY exchange, symbol, b")
def sigma(spark, sf):
    out = windows.finalize(windows.bucketed(ad.event_trades(spark, sf), HOUR_US), "p", HOUR_US, HOUR_US, ("sigma",))
    return rounded(out.select("exchange", "symbol", "b", "sigma"), "sigma", digits=4)


LONG_SQL = BUCKETED_SQL + f",\nlong AS (SELECT exchange, symbol, b, {FEATURES_SQL} FROM b GROUP BY exchange, symbol, b)"


def _long(spark, sf):
    return windows.tumbling(ad.event_trades(spark, sf), HOUR_US).withColumn("window_ms", F.lit(3_600_000))


@query(f"WITH {LONG_SQL} SELECT symbol, make_timestamp(b * {HOUR_US}) AS sampled_time, max(CASE WHEN exchange = 'X0' THEN asset_return END) - max(CASE WHEN exchange = 'X1' THEN asset_return END) AS diff FROM long GROUP BY symbol, b")
def exchange_diff(spark, sf):
    out = panel.exchange_differences(_long(spark, sf), "X0", ("X1",), (3_600_000,))
    return out.toDF("symbol", "sampled_time", "diff")


@query(
    f"WITH {LONG_SQL}, own AS (SELECT symbol, b, max(CASE WHEN exchange = 'X0' THEN asset_return END) AS self_return, max(CASE WHEN exchange = 'X0' THEN flow_imbalance END) AS self_flow_x0, max(CASE WHEN exchange = 'X1' THEN flow_imbalance END) AS self_flow_x1 FROM long GROUP BY symbol, b),"
    " market AS (SELECT b, max(CASE WHEN exchange = 'X0' THEN asset_return END) AS market_return, max(CASE WHEN exchange = 'X1' THEN flow_imbalance END) AS market_flow_x1 FROM long WHERE symbol = 'click' GROUP BY b),"
    " ids AS (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS currency_index FROM (SELECT DISTINCT symbol FROM long))"
    f" SELECT symbol, make_timestamp(own.b * {HOUR_US}) AS sampled_time, currency_index, self_return, self_flow_x0, self_flow_x1, market_return, market_flow_x1 FROM own LEFT JOIN market ON own.b = market.b JOIN ids USING (symbol)"
)
def market_panel(spark, sf):
    long = rounded(_long(spark, sf), *RATIOS)
    ids = cs.category_codes(long.select("symbol").distinct(), "symbol", "currency_index")
    wide = panel.build_panel(long, {"BTC": "click"}, (3_600_000,), ("X0", "X1"), "X0", ids)
    names = {"self_return": "SELF-asset_return-3600S@X0", "self_flow_x0": "SELF-flow_imbalance-3600S@X0", "self_flow_x1": "SELF-flow_imbalance-3600S@X1", "market_return": "BTC-asset_return-3600S@X0", "market_flow_x1": "BTC-flow_imbalance-3600S@X1"}
    return wide.select("symbol", "sampled_time", "currency_index", *[F.col(f"`{c}`").alias(n) for n, c in names.items()])


TARGET_SQL = CLOSE_SQL + ",\nt AS (SELECT *, (lead(close_price, 3) OVER (PARTITION BY exchange, symbol ORDER BY b) / NULLIF(close_price, 0) - 1) * 1e4 AS output FROM c)"


@query(f"WITH {TARGET_SQL} SELECT * FROM t")
def forward_return(spark, sf):
    return panel.forward_return(_closes(spark, sf), 3)


@query(f"WITH {TARGET_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY exchange, symbol ORDER BY b) - 1 AS k, count(*) OVER (PARTITION BY exchange, symbol) AS n FROM t WHERE output IS NOT NULL) SELECT exchange, symbol, b, CASE WHEN k < floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN k < floor(n * (CAST(0.7 AS DOUBLE) + CAST(0.2 AS DOUBLE))) THEN 'validation' ELSE 'test' END AS split FROM k")
def chrono_split(spark, sf):
    rows = panel.usable(panel.forward_return(_closes(spark, sf), 3), "output", ["close_price"])
    return panel.chronological_split(rows, 0.7, 0.2, 0.1, ("exchange", "symbol"), ("b",)).select("exchange", "symbol", "b", "split")


PREDICTED_SQL = TARGET_SQL + f",\np AS (SELECT t.symbol AS currency, t.output AS truth, -coalesce(long.asset_return, 0.0) AS prediction FROM t LEFT JOIN (SELECT exchange, symbol, b, {RETURN_SQL} AS asset_return FROM b GROUP BY exchange, symbol, b) long USING (exchange, symbol, b) WHERE t.output IS NOT NULL)"
METRICS_SQL = f"SELECT coalesce(currency, 'ALL') AS currency, {near('1 - sum((truth - prediction) * (truth - prediction)) / (var_pop(truth) * count(*))', 6)} AS \"R2\", {near('avg(abs(truth - prediction))', 4)} AS \"MAE\", 2.0 * sum(CAST(truth > 0 AND prediction > 0 AS INTEGER)) / NULLIF(sum(CAST(truth > 0 AS INTEGER)) + sum(CAST(prediction > 0 AS INTEGER)), 0) AS \"F1\", sum(CAST((truth > 0) = (prediction > 0) AS INTEGER)) / CAST(count(*) AS DOUBLE) AS \"Accuracy\" FROM p GROUP BY GROUPING SETS ((), (currency))"


@query(f"WITH {PREDICTED_SQL} {METRICS_SQL}")
def metrics_grouping_sets(spark, sf):
    target = panel.forward_return(_closes(spark, sf), 3)
    returns = windows.tumbling(ad.event_trades(spark, sf), HOUR_US).select("exchange", "symbol", "b", "asset_return")
    rows = target.join(returns, ["exchange", "symbol", "b"], "left").select(F.col("symbol").alias("currency"), F.col("output").alias("truth"), (-F.coalesce("asset_return", F.lit(0.0))).alias("prediction"))
    return rounded(rounded(panel.metrics(rows), "R2", digits=6), "MAE", digits=4)


GAINS_SQL = "gains AS (SELECT p_type AS feature, p_size AS horizon, CAST(p_retailprice AS DOUBLE) AS gain FROM part)"


def _gains(spark, sf):
    return table(spark, sf, "part").select(F.col("p_type").alias("feature"), F.col("p_size").alias("horizon"), F.col("p_retailprice").cast("double").alias("gain"))


@query(f"WITH {GAINS_SQL}, s AS (SELECT feature, {near('sum(gain)', 3)} AS importance FROM gains GROUP BY feature) SELECT * FROM s ORDER BY importance DESC, feature LIMIT 25")
def topk_importance(spark, sf):
    total = rounded(_gains(spark, sf).groupBy("feature").agg(F.sum("gain").alias("importance")), "importance", digits=3)
    return cs.top_k(total, "importance", 25, "feature")


_H = (1, 2, 3, 4, 5)


@query(
    f"WITH {GAINS_SQL}, g AS (SELECT feature, horizon, sum(gain) AS gain FROM gains WHERE horizon IN {_H} GROUP BY feature, horizon), s AS (SELECT *, gain / sum(gain) OVER (PARTITION BY horizon) AS share FROM g)"
    f" SELECT feature, {', '.join(f'{near(f'coalesce(sum(CASE WHEN horizon = {h} THEN share END), 0.0)')} AS h{h}' for h in _H)}, {near('sum(share) / 5')} AS mean_share FROM s GROUP BY feature"
)
def pivot_normalise(spark, sf):
    wide = cs.pivot_normalised(_gains(spark, sf).where(F.col("horizon").isin(*_H)), "feature", "horizon", "gain", list(_H))
    return rounded(wide, *[f"h{h}" for h in _H], "mean_share")


@query("SELECT DISTINCT event_type AS symbol FROM events WHERE event_type LIKE '%k' AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-09 23:59:59.999999'")
def symbols_endswith_distinct(spark, sf):
    bounds = Bounds.for_days(datetime(2024, 1, 2).date(), datetime(2024, 1, 10).date())
    return ad.event_ticks(spark, sf).where(bounds.predicate() & F.col("symbol").endswith("k")).select("symbol").distinct()


_LOOK = pumps.LOOKBACKS
_AIM = {f"{k}0MIN": 10 * w for k, w in zip(range(1, 6), pumps.TARGETS.values(), strict=True)}


def _pump_events(spark, sf):
    ticks = ad.event_ticks(spark, sf).where(F.col("trade_time") >= F.lit(datetime(2024, 1, 11)).cast("timestamp_ntz"))
    firsts = ticks.groupBy(F.col("symbol").alias("event")).agg(F.min("trade_time").alias("at"))
    return firsts.select("event", F.unix_micros(F.col("at").cast("timestamp")).alias("event_us"))


def _pump_sql() -> str:
    def f(condition: str) -> dict[str, str]:
        only = f"FILTER (WHERE {condition})"
        return {
            "asset_return": f"(last(price_last ORDER BY trade_us) {only} / NULLIF(first(price_last_prev ORDER BY trade_us) {only}, 0) - 1) * 1e4",
            "share_of_long_trades": near(f"avg(CAST(is_long AS INTEGER)) {only}"),
            "powerlaw_alpha": near(f"CASE WHEN min(quantity_abs) {only} < max(quantity_abs) {only} THEN 1 + count(*) {only} / NULLIF(sum(ln(quantity_abs)) {only} - count(*) {only} * ln(min(quantity_abs) {only}), 0) END"),
            "slippage_imbalance": near(f"sum(slippage_sign) {only} / NULLIF(sum(slippage_abs) {only}, 0)"),
            "flow_imbalance": near(f"sum(quote_sign) {only} / NULLIF(sum(quote_abs) {only}, 0)"),
            "num_trades": f"count(*) {only}",
        }

    look = lambda c, w: f"{c} >= event_us - {HOUR_US} - {w} AND {c} <= event_us - {HOUR_US}"
    columns = [f'{s} AS "{name}@{n}"' for n, w in _LOOK.items() for name, s in f(look("trade_us", w)).items()]
    columns += [f'{f(f"trade_us >= event_us AND trade_us <= event_us + {w}")["asset_return"]} AS "target_return@{n}"' for n, w in _AIM.items()]
    scores = [f'{near(f"avg({c}) FILTER (WHERE {look("hour_us", w)}) / NULLIF(stddev_samp({c}), 0)")} AS "{c}_zscore@{n}"' for n, w in _LOOK.items() for c in ("asset_return", "quote_abs")]
    day = 24 * HOUR_US
    return (
        f"WITH {EVENTS_SQL}, e AS (SELECT symbol AS event, epoch_us(min(trade_time)) AS event_us FROM ticks WHERE trade_time >= TIMESTAMP '2024-01-11 00:00:00' GROUP BY symbol),"
        f" near AS (SELECT trades.*, event, event_us FROM trades JOIN e ON trade_us BETWEEN event_us - {30 * day} AND event_us + {HOUR_US}),"
        f" hours AS (SELECT event, event_us, exchange, symbol, trade_us - trade_us % {HOUR_US} AS hour_us, {RETURN_SQL} AS asset_return, sum(quote_abs) AS quote_abs FROM near GROUP BY event, event_us, exchange, symbol, trade_us - trade_us % {HOUR_US}),"
        f" s AS (SELECT event, exchange, symbol, {', '.join(scores)} FROM hours GROUP BY event, exchange, symbol), f AS (SELECT event, exchange, symbol, {', '.join(columns)} FROM near GROUP BY event, exchange, symbol) SELECT * FROM f JOIN s USING (event, exchange, symbol)"
    )


@query(_pump_sql())
def pump_cross_section(spark, sf):
    out = pumps.cross_sections(ad.event_trades(spark, sf), _pump_events(spark, sf), _LOOK, _AIM)
    return rounded(out, *[c for c in out.columns if c.split("@")[0] in (*RATIOS, "asset_return_zscore", "quote_abs_zscore")])


_AT = FIRST_US + 20 * 24 * HOUR_US
_OFFSETS = {f"{d}d": d * 24 * HOUR_US for d in (1, 2, 3, 4, 5, 7, 10, 14, 20)}


@query(
    f"WITH {EVENTS_SQL}, h AS (SELECT exchange, symbol, trade_us - trade_us % {HOUR_US} AS hour_us, {RETURN_SQL} AS asset_return, sum(quote_abs) AS quote_abs FROM trades GROUP BY exchange, symbol, trade_us - trade_us % {HOUR_US})"
    f" SELECT exchange, symbol, {', '.join(f'{near(f'(avg(asset_return) FILTER (WHERE hour_us >= {_AT - w}) - avg(asset_return)) / NULLIF(stddev_samp(asset_return), 0)')} AS zscore_{n}, {near(f'stddev_samp(asset_return) FILTER (WHERE hour_us >= {_AT - w}) / NULLIF(stddev_samp(asset_return), 0)')} AS std_ratio_{n}' for n, w in _OFFSETS.items())},"
    f" {near('avg(quote_abs) / NULLIF(stddev_samp(quote_abs), 0)')} AS quote_ratio FROM h WHERE hour_us < {_AT} GROUP BY exchange, symbol"
)
def zscore_offsets(spark, sf):
    out = pumps.offset_scores(pumps.hourly_candles(ad.event_trades(spark, sf)), _AT, _OFFSETS)
    return rounded(out, *[c for c in out.columns if c not in ("exchange", "symbol")])


SECTIONS_SQL = "sections AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS start_day, CAST(o_custkey % 40 AS VARCHAR) AS asset, floor(avg(CAST(o_totalprice AS DOUBLE)) * 100 + 0.5) / 100 AS price, count(*) AS n FROM orders GROUP BY ALL)"


def _sections(spark, sf):
    o = table(spark, sf, "orders")
    out = o.groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("start_day"), (F.col("o_custkey") % 40).cast("string").alias("asset")).agg(F.avg(F.col("o_totalprice").cast("double")).alias("price"), F.count("*").alias("n"))
    return rounded(out, "price", digits=2)


@query(f"WITH {SECTIONS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY start_day ORDER BY n DESC) + (count(*) OVER (PARTITION BY start_day, n) - 1) / 2.0 AS rank FROM sections) SELECT start_day, asset, CAST(rank AS DOUBLE) AS rank, rank <= 5 AS is_top_5 FROM r")
def cs_rank_avg(spark, sf):
    ranked = _sections(spark, sf).withColumn("rank", cs.average_rank("n", ["start_day"]).cast("double"))
    return ranked.select("start_day", "asset", "rank", (F.col("rank") <= 5).alias("is_top_5"))


@query(f"WITH {SECTIONS_SQL} SELECT start_day, asset, {near('(price - avg(price) OVER w) / NULLIF(stddev_samp(price) OVER w, 0)', 6)} AS z FROM sections WINDOW w AS (PARTITION BY start_day)")
def cs_zscore(spark, sf):
    return rounded(_sections(spark, sf).select("start_day", "asset", cs.zscore("price", ["start_day"]).alias("z")), "z", digits=6)


@query(f"WITH {SECTIONS_SQL} SELECT start_day, asset, dense_rank() OVER (ORDER BY start_day) - 1 AS section_id, dense_rank() OVER (ORDER BY asset) - 1 AS asset_code FROM sections")
def cs_id(spark, sf):
    numbered = cs.section_ids(_sections(spark, sf).withColumn("end_day", F.last_day("start_day")), "start_day", "end_day")
    return cs.category_codes(numbered, "asset", "asset_code").select("start_day", "asset", F.col("section_id").cast("bigint").alias("section_id"), F.col("asset_code").cast("bigint").alias("asset_code"))


@query(f"WITH {SECTIONS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY start_day) AS k FROM sections) SELECT start_day, asset, price FROM k WHERE k > 1")
def drop_first_per_key(spark, sf):
    return cs.drop_first(_sections(spark, sf), ["asset"], ["start_day"]).select("start_day", "asset", "price")


RETURNS_SQL = SECTIONS_SQL + ",\nrets AS (SELECT dense_rank() OVER (ORDER BY start_day) - 1 AS section, asset, price / lag(price) OVER (PARTITION BY asset ORDER BY start_day) - 1 AS past, lead(price) OVER (PARTITION BY asset ORDER BY start_day) / price - 1 AS realised FROM sections)"


def _returns(spark, sf):
    from pyspark.sql import Window

    rows = cs.section_ids(_sections(spark, sf).withColumn("end_day", F.last_day("start_day")), "start_day", "end_day")
    w = Window.partitionBy("asset").orderBy("start_day")
    return rows.select(F.col("section_id").cast("bigint").alias("section"), "asset", (safe_div(F.col("price"), F.lag("price").over(w)) - 1).alias("past"), (safe_div(F.lead("price").over(w), F.col("price")) - 1).alias("realised"))


STRATEGY_SQL = RETURNS_SQL + (
    ",\ntop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY past DESC NULLS LAST, asset) AS k FROM rets WHERE past IS NOT NULL AND realised IS NOT NULL) WHERE k <= 10),"
    " held AS (SELECT section, avg(realised) AS gross, count(*) AS size FROM top GROUP BY section),"
    " kept AS (SELECT a.section, count(*) AS kept FROM top a JOIN top b ON a.section = b.section + 1 AND a.asset = b.asset GROUP BY a.section),"
    " s AS (SELECT h.section, h.gross, CAST(h.size + coalesce(p.size, 0) - 2 * coalesce(k.kept, 0) AS INTEGER) AS traded FROM held h LEFT JOIN held p ON p.section = h.section - 1 LEFT JOIN kept k ON k.section = h.section),"
    " pnl AS (SELECT section, gross, traded, gross - traded * (CAST(0.1 AS DOUBLE) * CAST(0.00075 AS DOUBLE)) AS pnl FROM s)"
)


def _pnl(spark, sf):
    return cs.strategy(_returns(spark, sf).dropna(subset=["past", "realised"]), "section", "asset", "past", "realised")


@query(f"WITH {STRATEGY_SQL} SELECT section, {near('gross')} AS gross, traded, {near('pnl')} AS pnl FROM pnl")
def portfolio_strategy(spark, sf):
    return rounded(_pnl(spark, sf), "gross", "pnl")


@query(f"WITH {STRATEGY_SQL} SELECT section, {near('sum(pnl) OVER (ORDER BY section ROWS UNBOUNDED PRECEDING)', 8)} AS total FROM pnl")
def cum_pnl(spark, sf):
    return rounded(_pnl(spark, sf).select("section", cs.cumulative(_pnl(spark, sf), "pnl", "section").alias("total")), "total", digits=8)


@query(
    f"WITH {RETURNS_SQL}, a AS (SELECT asset, count(past) AS n FROM rets WHERE section < 30 GROUP BY asset), b AS (SELECT asset, max(past) AS best FROM rets WHERE section >= 30 AND asset < '3' GROUP BY asset), c AS (SELECT asset, min(realised) AS worst FROM rets WHERE asset > '2' GROUP BY asset)"
    " SELECT asset, n, best, worst FROM a FULL JOIN b USING (asset) FULL JOIN c USING (asset)"
)
def stats_outer_join(spark, sf):
    r = _returns(spark, sf)
    a = r.where("section < 30").groupBy("asset").agg(F.count("past").alias("n"))
    b = r.where("section >= 30 and asset < '3'").groupBy("asset").agg(F.max("past").alias("best"))
    c = r.where("asset > '2'").groupBy("asset").agg(F.min("realised").alias("worst"))
    return a.join(b, "asset", "full_outer").join(c, "asset", "full_outer")


@query(
    f"WITH {LONG_SQL} "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS missing, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS largest, {near(f'avg({c})', 4)} AS mean FROM long" for c in ("asset_return", "flow_imbalance", "powerlaw_alpha", "num_trades"))
)
def null_profile(spark, sf):
    return rounded(cs.null_profile(rounded(_long(spark, sf), *RATIOS), ["asset_return", "flow_imbalance", "powerlaw_alpha", "num_trades"]), "mean", digits=4)


@query(f"WITH {LONG_SQL} SELECT exchange, symbol, b, CASE WHEN powerlaw_alpha IS NOT NULL THEN least(greatest(powerlaw_alpha, 1.0), 2.0) END AS alpha, coalesce(asset_return, 0.0) AS asset_return FROM long")
def clip_replace(spark, sf):
    out = rounded(_long(spark, sf), *RATIOS)
    return out.select("exchange", "symbol", "b", clip(keep_finite(F.col("powerlaw_alpha")), 1.0, 2.0).alias("alpha"), F.coalesce("asset_return", F.lit(0.0)).alias("asset_return"))


@query(f"WITH {TARGET_SQL}, u AS (" + " UNION ALL ".join(f"SELECT exchange, symbol, b, {h} AS horizon, (lead(close_price, {h}) OVER (PARTITION BY exchange, symbol ORDER BY b) / NULLIF(close_price, 0) - 1) * 1e4 AS output FROM c" for h in (1, 6)) + ") SELECT * FROM u WHERE output IS NOT NULL")
def union_horizons(spark, sf):
    closes = _closes(spark, sf)
    parts = [panel.forward_return(closes, h).withColumn("horizon", F.lit(h)).select("exchange", "symbol", "b", "horizon", "output") for h in (1, 6)]
    return parts[0].unionByName(parts[1]).dropna(subset=["output"])


@query("SELECT p_partkey, split_part(p_type, ' ', 1) AS base, regexp_extract(p_type, '([A-Z]+)$', 1) AS term, upper(p_name) AS upper_name, CAST(p_size IN (1, 5, 9) AS BOOLEAN) AS chosen FROM part")
def symbol_split_regex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.split("p_type", " ")[0].alias("base"), F.regexp_extract("p_type", "([A-Z]+)$", 1).alias("term"), F.upper("p_name").alias("upper_name"), F.col("p_size").isin(1, 5, 9).alias("chosen"))


_MONTH = Bounds.for_days(datetime(2024, 1, 1).date(), datetime(2024, 1, 31).date())


@query("WITH p AS (SELECT g AS piece, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 5 DAY * g AS lb, least(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 5 DAY * g + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND, TIMESTAMP '2024-01-30 23:59:59.999999') AS rb FROM generate_series(0, 5) AS s(g)) SELECT CAST(piece AS INTEGER) AS piece, event_type AS symbol, count(*) AS n FROM events JOIN p ON ts BETWEEN lb AND rb GROUP BY piece, event_type")
def bounds_overlapping(spark, sf):
    pieces = _MONTH.pieces_of(F.col("trade_time"), timedelta(days=5), timedelta(days=7))
    ticks = ad.event_ticks(spark, sf).where(_MONTH.predicate()).select("symbol", F.explode(pieces).alias("piece"))
    return ticks.groupBy("piece", "symbol").agg(F.count("*").alias("n"))


@query(f"WITH {BUCKETED_SQL} SELECT g.exchange, g.symbol, g.b, first(price_first ORDER BY trade_us) AS open, last(price_last ORDER BY trade_us) AS close FROM b g GROUP BY g.exchange, g.symbol, g.b")
def sampled_open_close(spark, sf):
    ticks = ad.event_ticks(spark, sf).withColumn("b", windows.bucket(F.unix_micros(F.col("trade_time").cast("timestamp")), HOUR_US))
    rank = F.struct("trade_time", "trade_id")
    return ticks.groupBy("exchange", "symbol", "b").agg(F.min_by("price", rank).alias("open"), F.max_by("price", rank).alias("close"))


@query(f"WITH {EVENTS_SQL} SELECT exchange, symbol, {near('ln(last(price_last ORDER BY trade_us) / first(price_last ORDER BY trade_us))')} AS log_return FROM trades WHERE trade_us BETWEEN {_AT} AND {_AT + 48 * HOUR_US} GROUP BY exchange, symbol")
def interval_log_return(spark, sf):
    return rounded(pumps.interval_log_return(ad.event_trades(spark, sf), _AT, 48 * HOUR_US), "log_return")


@query(f"WITH {STRATEGY_SQL}, pairs AS (SELECT section, asset FROM top), bought AS (SELECT * FROM pairs EXCEPT SELECT section + 1, asset FROM pairs) SELECT r.section, r.asset, r.past FROM rets r WHERE EXISTS (SELECT 1 FROM bought b WHERE b.section = r.section AND b.asset = r.asset)")
def bought_assets(spark, sf):
    from pyspark.sql import Window

    r = _returns(spark, sf)
    top = r.dropna(subset=["past", "realised"]).withColumn("k", F.row_number().over(Window.partitionBy("section").orderBy(F.desc("past"), "asset"))).where("k <= 10").select("section", "asset")
    bought = top.join(top.select((F.col("section") + 1).alias("section"), "asset"), ["section", "asset"], "left_anti")
    return r.join(bought, ["section", "asset"], "left_semi").select("section", "asset", "past")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-05 23:59:59.999999'")
def row_count(spark, sf):
    return ad.event_ticks(spark, sf).where(Bounds.for_day(datetime(2024, 1, 5).date()).predicate()).agg(F.count("*").alias("n"))


@query(
    f"WITH {GRID_SQL}, c AS (SELECT exchange, symbol, b, last(price_last ORDER BY trade_us) AS close FROM b GROUP BY exchange, symbol, b)"
    + ", ".join(["", *[f"x{k} AS (SELECT g.exchange, g.symbol, g.b, {k * 3600000} AS window_ms, coalesce(y.asset_return, 0.0) AS asset_return, y.flow_imbalance, y.num_trades FROM grid g LEFT JOIN (SELECT g.exchange, g.symbol, g.b, {FEATURES_SQL} FROM (SELECT exchange, symbol, b FROM grid) g JOIN b USING (exchange, symbol) WHERE b.b > g.b - {k} AND b.b <= g.b GROUP BY g.exchange, g.symbol, g.b) y USING (exchange, symbol, b))" for k in (1, 4, 12)]])
    + " SELECT exchange, symbol, b, CAST(window_ms AS BIGINT) AS window_ms, asset_return, flow_imbalance, coalesce(num_trades, 0) AS num_trades FROM (SELECT * FROM x1 UNION ALL SELECT * FROM x4 UNION ALL SELECT * FROM x12)"
)
def sampled_features(spark, sf):
    out = windows.sampled(ad.event_trades(spark, sf), HOUR_US, [1, 4, 12], FIRST_US, LAST_US)
    return rounded(out.select("exchange", "symbol", "b", "window_ms", "asset_return", "flow_imbalance", "num_trades"), "flow_imbalance")


def _model_rows(spark, sf):
    wide = windows.sampled(ad.event_trades(spark, sf), HOUR_US, [1, 6], FIRST_US, LAST_US)
    pick = lambda c, w: F.max(F.when(F.col("window_ms") == w, F.col(c)))
    one, six = 3_600_000, 21_600_000
    columns = [pick(c, one).alias(c) for c in ("close_price", "asset_return", "flow_imbalance", "powerlaw_alpha")] + [pick("asset_return", six).alias("return_6h"), pick("flow_imbalance", six).alias("flow_6h")]
    return wide.groupBy("exchange", "symbol", "b").agg(*columns).withColumn("currency", F.col("symbol"))


REGRESSORS = ["asset_return", "flow_imbalance", "powerlaw_alpha", "return_6h", "flow_6h", "currency"]


@query()
def boosted_metrics(spark, sf):
    """A horizon's selection, refit with early stopping and metrics by symbol, with fewer trees than the default; boosting has no SQL."""
    split = lambda df: panel.chronological_split(df, 0.8, 0.1, 0.1, ("exchange", "symbol"), ("b",))
    found, _ = model.sweep(_model_rows(spark, sf), REGRESSORS, [3], "symbol", split, model.Boosting(trees=10), 3, ("currency",))
    return found


@query(f"WITH {LINES_SQL}, sided AS (SELECT exchange, symbol, trade_id, trade_time, price, quantity, CASE WHEN side = 'SELL' THEN -1 ELSE 1 END AS s FROM (SELECT *, l_orderkey * 10 + l_linenumber AS trade_id, CASE WHEN l_returnflag = 'R' THEN 'SELL' WHEN l_returnflag = 'A' THEN 'buy' END AS side FROM ticks)) SELECT exchange, symbol, trade_id, trade_time, s AS side_sign, price * quantity AS quote_abs, price * quantity * s AS quote_sign, quantity * s AS quantity_sign FROM sided")
def sided_enriched(spark, sf):
    """Ticks that name a side instead of the maker."""
    side = F.when(F.col("l_returnflag") == "R", "SELL").when(F.col("l_returnflag") == "A", "buy")
    ticks = ad.line_ticks(spark, sf).select("exchange", "symbol", "trade_time", "price", "quantity", (F.col("rank.l_orderkey") * 10 + F.col("rank.l_linenumber")).alias("trade_id"), F.col("rank.l_returnflag").alias("l_returnflag"))
    out = tr.enrich(ticks.withColumn("side", side), lambda: side_sign(F.col("side")))
    return out.select("exchange", "symbol", "trade_id", "trade_time", "side_sign", "quote_abs", "quote_sign", "quantity_sign")


@query(f"WITH {GRID_SQL}, o AS (SELECT exchange, symbol, b, first(price_first ORDER BY trade_us) AS open FROM b GROUP BY exchange, symbol, b) SELECT g.exchange, g.symbol, g.b, coalesce(o.open, -1.0) AS open FROM o RIGHT JOIN grid g USING (exchange, symbol, b)")
def grid_right_join(spark, sf):
    """First prices of the grid's steps, -1 where a step has none."""
    trades = ad.event_trades(spark, sf).withColumn("b", windows.bucket(F.col("trade_us"), HOUR_US))
    first = trades.groupBy("exchange", "symbol", "b").agg(F.min_by("price_first", "trade_us").alias("open"))
    return first.join(windows.grid(trades, FIRST_US, LAST_US, HOUR_US), ["exchange", "symbol", "b"], "right").withColumn("open", F.coalesce("open", F.lit(-1.0)))


@query("SELECT symbol, CASE WHEN len(p) = 2 THEN p[1] END AS base, CASE WHEN len(p) = 2 THEN p[2] END AS term, coalesce(len(p) = 2 AND p[1] IN ('BUILDING', 'MACHINERY'), FALSE) AS is_stable, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS currency_index FROM (SELECT symbol, string_split(symbol, '-') AS p FROM (SELECT DISTINCT c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS symbol FROM customer))")
def instrument_dimension(spark, sf):
    symbols = table(spark, sf, "customer").select(F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("symbol"))
    return instruments.instruments(symbols, ("BUILDING", "MACHINERY")).withColumn("currency_index", F.col("currency_index").cast("int"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST('0x' || substr(md5('7|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) < CAST(floor(0.1 * 4294967296) AS BIGINT)")
def row_sample(spark, sf):
    return instruments.sample_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 0.1, 7)


@query(f"WITH {EVENTS_SQL} SELECT exchange, symbol, date_trunc('hour', trade_time) AS start, first(price ORDER BY trade_time, trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY trade_time, trade_id) AS close, {near('sum(quote_abs)', 4)} AS quote_abs, {near('sum(quote_sign) / NULLIF(sum(quote_abs), 0)')} AS flow_imbalance, count(*) AS num_ticks FROM enriched GROUP BY exchange, symbol, date_trunc('hour', trade_time)")
def stream_candles(spark, sf):
    """The streaming candles' plan over a bounded input."""
    ticks = ad.event_ticks(spark, sf).withColumn("trade_time", F.col("trade_time").cast("timestamp"))
    out = candles(ticks).withColumn("start", F.col("start").cast("timestamp_ntz"))
    return rounded(rounded(out, "quote_abs", digits=4), "flow_imbalance")


@query(f"WITH {BUCKETED_SQL} SELECT DISTINCT exchange, symbol, make_timestamp(b * {HOUR_US}) AS sampled_time FROM b EXCEPT SELECT exchange, symbol, make_timestamp(b * {HOUR_US}) FROM b WHERE is_long")
def hours_without_longs(spark, sf):
    trades = ad.event_trades(spark, sf).withColumn("sampled_time", from_micros(windows.bucket(F.col("trade_us"), HOUR_US) * HOUR_US))
    return trades.select("exchange", "symbol", "sampled_time").distinct().exceptAll(trades.where("is_long").select("exchange", "symbol", "sampled_time").distinct())


@query(f"WITH {BUCKETED_SQL} SELECT exchange, symbol, make_timestamp((b - 1) * {HOUR_US}) AS window_start, make_timestamp(b * {HOUR_US}) AS window_end, count(*) AS num_trades FROM b GROUP BY exchange, symbol, b")
def window_edges(spark, sf):
    out = windows.with_edges(windows.tumbling(ad.event_trades(spark, sf), HOUR_US), HOUR_US)
    return out.select("exchange", "symbol", "window_start", "window_end", "num_trades")


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-20 06:00:00' THEN 'train' WHEN ts <= TIMESTAMP '2024-01-25 12:30:00' THEN 'validation' ELSE 'test' END AS split FROM events")
def time_split(spark, sf):
    at = lambda *x: F.lit(datetime(2024, 1, *x)).cast("timestamp_ntz")
    return panel.split_at(table(spark, sf, "events"), at(20, 6), at(25, 12, 30), "ts").select("event_id", "split")


@query("SELECT c_custkey, c_name, n_name AS c_mktsegment, n_regionkey FROM customer LEFT JOIN (SELECT n_nationkey AS c_nationkey, n_name, n_regionkey FROM nation) USING (c_nationkey)")
def override_columns(spark, sf):
    """Of columns that both tables have, the right one's."""
    right = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c_mktsegment"), "n_regionkey")
    return panel.override(table(spark, sf, "customer"), right, ["c_nationkey"]).select("c_custkey", "c_name", "c_mktsegment", "n_regionkey")


@query("SELECT o_orderkey, make_timestamp(CASE WHEN o_orderdate < DATE '1996-01-01' THEN o_orderkey * 1000 ELSE o_orderkey END) AS moment, make_timestamp(o_orderkey * 1000) AS millis, strftime(o_orderdate, '%Y%m') AS month, o_orderdate::DATE - INTERVAL 1 DAY = last_day(o_orderdate::DATE - INTERVAL 1 DAY) AS first_of_month FROM orders")
def epoch_times(spark, sf):
    """Milliseconds, or microseconds from a day on, as times; months and their ends."""
    day = F.to_date("o_orderdate")
    shifted = F.date_add(day, 10_593)  # 1996-01-01 becomes the day from which epochs are microseconds
    before = F.date_sub(day, 1)
    orders = table(spark, sf, "orders")
    return orders.select("o_orderkey", epoch_to_time(F.col("o_orderkey").cast("bigint"), shifted).alias("moment"), epoch_to_time(F.col("o_orderkey").cast("bigint")).alias("millis"), F.date_format(day, "yyyyMM").alias("month"), (before == F.last_day(before)).alias("first_of_month"))


_SPAN = Bounds.for_days(datetime(2023, 12, 18).date(), datetime(2024, 3, 6).date())


@query(
    "SELECT 'day' AS kind, strftime(d, '%Y-%m-%d') AS name FROM generate_series(TIMESTAMP '2023-12-18', TIMESTAMP '2024-03-05', INTERVAL 1 DAY) AS s(d) UNION ALL SELECT DISTINCT 'month', strftime(d, '%Y%m') FROM generate_series(TIMESTAMP '2023-12-18', TIMESTAMP '2024-03-05', INTERVAL 1 DAY) AS s(d)"
    " UNION ALL SELECT 'whole', m FROM (VALUES ('202401'), ('202402')) AS v(m) UNION ALL SELECT 'part', strftime(d, '%Y-%m-%d') FROM generate_series(TIMESTAMP '2023-12-18', TIMESTAMP '2024-03-05', INTERVAL 1 DAY) AS s(d) WHERE month(d) IN (12, 3)"
    " UNION ALL SELECT 'padded', '2023-12-17 21:00:00..2024-03-06 00:59:59' UNION ALL SELECT 'after', '2024-03-05 23:59:59..2024-03-06 01:59:59'"
)
def calendar_pieces(spark, sf):
    """Days, months, whole months with the days around them, padded and following intervals."""
    head, whole, tail = _SPAN.month_chunks()
    rows = [("day", str(d)) for d in _SPAN.days()] + [("month", m) for m in _SPAN.months()] + [("whole", m) for m in whole] + [("part", str(d)) for d in [*head, *tail]]
    rows += [("padded", str(_SPAN.padded(timedelta(hours=3), timedelta(hours=1)))), ("after", str(_SPAN.shifted(timedelta(hours=2))))]
    return spark.createDataFrame(rows, "kind string, name string")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events")
def event_props(spark, sf):
    parsed = F.from_json("props", "k BIGINT, none STRING")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), parsed["none"].alias("none"))


@query(f"WITH {RETURNS_SQL} SELECT section, asset, past, realised FROM rets WHERE NOT (coalesce(past, 1) = 0 AND coalesce(realised, 1) = 0) AND past BETWEEN -0.5 AND 0.5")
def informative_rows(spark, sf):
    return cs.informative(_returns(spark, sf), ["past", "realised"], 0.5)


@query(f"WITH {RETURNS_SQL}, r AS (SELECT section, asset, past FROM rets WHERE past IS NOT NULL) SELECT 'head' AS part, * FROM (SELECT * FROM r ORDER BY past DESC, asset LIMIT 7) UNION ALL SELECT 'tail', * FROM (SELECT * FROM r ORDER BY past, asset DESC LIMIT 7)")
def head_and_tail(spark, sf):
    r = _returns(spark, sf).where("past is not null").select("section", "asset", "past").withColumn("tie", F.concat_ws("|", "asset", F.format_string("%06d", "section")))
    parts = [cs.top_k(r, "past", 7, "tie").withColumn("part", F.lit("head")), cs.last_k(r, "past", 7, "tie").withColumn("part", F.lit("tail"))]
    return parts[0].unionByName(parts[1]).drop("tie")


@query(f"WITH {TARGET_SQL} SELECT close_price, b AS step, output FROM t WHERE output IS NOT NULL AND close_price IS NOT NULL")
def merged_samples(spark, sf):
    """Datasets of two venues, merged split by split and united: every usable row once, of the feature set's columns."""
    rows = panel.usable(panel.forward_return(_closes(spark, sf), 3), "output", ["close_price"]).withColumn("step", F.col("b"))
    features = FeatureSet(("close_price",), "output", evaluation=("step",))
    split = panel.chronological_split(rows, 0.7, 0.2, 0.1, ("exchange", "symbol"), ("b",))
    samples = [{s: (split.where((F.col("exchange") == e) & (F.col("split") == s)), features) for s in ("train", "validation", "test")} for e in ("X0", "X1")]
    merged = panel.merge_samples(samples)
    return panel.union_datasets([merged[s] for s in ("train", "validation", "test")])[0]


_SOME_DAYS = Bounds.for_days(datetime(2024, 1, 3).date(), datetime(2024, 1, 6).date())


@query(f"WITH {EVENTS_SQL} SELECT exchange, date, symbol, trade_id, trade_time, price, quantity, is_buyer_maker FROM ticks WHERE date BETWEEN DATE '2024-01-03' AND DATE '2024-01-05' AND symbol IN ('click', 'view')")
def stored_ticks(spark, sf):
    """Ticks written by exchange, date and symbol in two overlapping runs, and read by days and symbols."""
    root = scratch.folder(spark, "ticks")
    ticks = ad.event_ticks(spark, sf).where(F.col("date").between("2024-01-01", "2024-01-08"))
    for days in (("2024-01-01", "2024-01-05"), ("2024-01-04", "2024-01-08")):
        ingest.write_ticks(ticks.where(F.col("date").between(*days)), root)
    names = ("exchange", "date", "symbol", "trade_id", "trade_time", "price", "quantity", "is_buyer_maker")
    return ingest.read_ticks(spark, root, _SOME_DAYS, ["click", "view"]).select(*names)


@query(
    f"WITH {GRID_SQL}, f AS (SELECT exchange, symbol, b, {FEATURES_SQL} FROM b GROUP BY exchange, symbol, b), x AS (SELECT g.exchange, g.symbol, make_timestamp(g.b * {HOUR_US}) AS sampled_time, coalesce(f.asset_return, 0.0) AS asset_return, f.flow_imbalance FROM grid g LEFT JOIN f USING (exchange, symbol, b))"
    " SELECT exchange, symbol, sampled_time, CASE WHEN symbol = 'view' AND day(sampled_time) = 4 THEN NULL ELSE asset_return END AS asset_return, CASE WHEN symbol = 'view' AND day(sampled_time) = 4 THEN NULL ELSE flow_imbalance END AS flow_imbalance FROM x WHERE sampled_time >= TIMESTAMP '2024-01-03' AND sampled_time < TIMESTAMP '2024-01-06'"
)
def stored_features(spark, sf):
    """Features written by day, of which one instrument's day is short, and read as whole days: the short one is missing."""
    root = scratch.folder(spark, "features")
    out = rounded(windows.sampled(ad.event_trades(spark, sf), HOUR_US, [1], FIRST_US, LAST_US), "flow_imbalance")
    short = (F.col("symbol") == "view") & (F.col("sampled_time") == F.lit(datetime(2024, 1, 4, 7)).cast("timestamp_ntz"))
    ingest.write_features(out.where(~short).select("exchange", "symbol", "sampled_time", "window_ms", "asset_return", "flow_imbalance"), root)
    return ingest.read_features(spark, root, _SOME_DAYS, 24).select("exchange", "symbol", "sampled_time", "asset_return", "flow_imbalance")


@query(f"WITH {GAINS_SQL}, s AS (SELECT feature, {near('sum(gain)', 3)} AS importance FROM gains GROUP BY feature), f AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) <= 25 AS allowed FROM s) SELECT * FROM f")
def stored_importances(spark, sf):
    """Importances written in order and read again, with the filter of the first 25."""
    path = scratch.folder(spark, "importances")
    total = rounded(_gains(spark, sf).groupBy("feature").agg(F.sum("gain").alias("importance")), "importance", digits=3)
    ingest.write_table(total, path, F.desc("importance"))
    chosen = ingest.first_features(spark, path, 25)
    return ingest.read_importances(spark, path).withColumn("allowed", F.col("feature").isin(sorted(chosen.names)))
