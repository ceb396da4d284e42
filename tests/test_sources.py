import json
import zipfile
from datetime import date, datetime

from pyspark.sql import functions as F

from tickloom.bounds import Bounds
from tickloom.operators import pumps
from tickloom.operators import trades as tr
from tickloom.sources import ingest as i
from tickloom.streaming.candles import candles


def write_zip(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("trades.csv", text.encode(encoding))


def test_zips_to_partitions_and_back(spark, tmp_path):
    write_zip(tmp_path / "raw/ADA-USDT/trades@2024-12-31.zip", "1,0.5,2,1.0,1735603200000,True,True\n2,0.6,2,1.2,1735603200001,False,True\n")
    write_zip(tmp_path / "raw/ADA-USDT/trades@2025-01-01.zip", "3,0.7,2,1.4,1735689600000000,False,True\n")
    write_zip(tmp_path / "raw/ADA-BTC/trades@2025-02-01.zip", "4,0.7,2,1.4,1738368000000000,False,True\n")
    bounds, root = Bounds.for_days(date(2024, 12, 31), date(2025, 1, 2)), str(tmp_path / "ticks")
    for _ in range(2):
        i.ingest(spark, f"{tmp_path}/raw/*/*.zip", root, "spot", "SPOT", bounds)
    rows = i.read_ticks(spark, root).orderBy("trade_id").collect()
    assert [(r.trade_id, str(r.date), r.symbol, r.trade_time, r.is_buyer_maker) for r in rows] == [
        (1, "2024-12-31", "ADA-USDT", datetime(2024, 12, 31), True), (2, "2024-12-31", "ADA-USDT", datetime(2024, 12, 31, 0, 0, 0, 1000), False), (3, "2025-01-01", "ADA-USDT", datetime(2025, 1, 1), False),
    ]
    day = Bounds.for_day(date(2025, 1, 1))
    assert i.read_ticks(spark, root, day, ["ADA-USDT"]).count() == 1
    assert "PartitionFilters: [" in i.read_ticks(spark, root, day)._jdf.queryExecution().toString()
    assert [r.symbol for r in i.symbols_in(spark, root, bounds, "USDT").collect()] == ["ADA-USDT"]


def test_futures_header_and_sided_files(spark, tmp_path):
    write_zip(tmp_path / "f/BTC-USDT/trades@2025-03-01.zip", "id,price,qty,quote,time,is_buyer_maker\n1,0.5,2,1.0,1740787200000,true\n")
    row = i.normalise(i.read_zips(spark, f"{tmp_path}/f/*/*.zip", "futures"), "futures", "USDM").first()
    assert (row.exchange, row.symbol, row.trade_time) == ("USDM", "BTC-USDT", datetime(2025, 3, 1))
    write_zip(tmp_path / "o/trades@2025-03-02.zip", "instrument,id,side,size,price,time\nA-É,1,SELL,2,0.5,1740787200000\nA-É,2,buy,2,0.5,1740873600000\n", "cp1252")
    out = i.normalise(i.read_zips(spark, f"{tmp_path}/o/*.zip", "sided"), "sided", "OKX").orderBy("trade_id").collect()
    assert [(r.symbol, str(r.date), r.side) for r in out] == [("A-É", "2025-03-01", "SELL"), ("A-É", "2025-03-02", "buy")]
    (tmp_path / "p/X-Y").mkdir(parents=True)
    (tmp_path / "p/X-Y/trades@2024-01-01.csv").write_text("1,0.5,2,1.0,1704067200000,True,True\n")
    assert i.normalise(i.read_csvs(spark, f"{tmp_path}/p/*/*.csv", "spot"), "spot", "S").first().symbol == "X-Y"


def sided_zip(path, rows):
    write_zip(path, "instrument,id,side,size,price,time\n" + "".join(f"A-B,{k},SELL,2,0.5,{t}\n" for k, t in rows), "cp1252")


def test_daily_runs_over_files_that_straddle_dates_lose_nothing(spark, tmp_path):
    """Each file holds the last trades of the date before its own; runs of single days, and again, leave all of them once."""
    first = 1740787200000  # 2025-03-01
    for day in range(3):
        at = first + day * 86_400_000
        sided_zip(tmp_path / f"o/trades@2025-03-0{day + 1}.zip", [(10 * day + k, at + (k - 2) * 3_600_000) for k in range(5)])
    for day in (1, 2, 3, 2):
        i.ingest(spark, f"{tmp_path}/o/*.zip", str(tmp_path / "t"), "sided", "OKX", Bounds.for_day(date(2025, 3, day)))
    rows = i.read_ticks(spark, str(tmp_path / "t")).collect()
    assert sorted(r.trade_id for r in rows) == [10 * d + k for d in range(3) for k in range(5)]
    assert all(r.date == r.trade_time.date() for r in rows)


def test_a_day_opens_only_its_files(spark, tmp_path):
    sided_zip(tmp_path / "o/trades@2025-03-01.zip", [(1, 1740787200000)])
    (tmp_path / "o/trades@2025-03-02.zip").write_bytes(b"no zip")
    day = Bounds.for_day(date(2025, 3, 1))
    assert i.read_zips(spark, f"{tmp_path}/o/*.zip", "sided", day).count() == 1
    i.ingest(spark, f"{tmp_path}/o/*.zip", str(tmp_path / "t"), "sided", "OKX", day)
    assert i.read_ticks(spark, str(tmp_path / "t")).count() == 1
    for name, text in (("2024-01-01", "1,0.5,2,1.0,1704067200000,True,True\n"), ("2024-01-02", "2,0.5,2,1.0,1704153600000,True,True\n")):
        (tmp_path / "p/X-Y").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"p/X-Y/trades@{name}.csv").write_text(text)
    got = i.normalise(i.read_csvs(spark, f"{tmp_path}/p/*/*.csv", "spot", Bounds.for_day(date(2024, 1, 2))), "spot", "S", Bounds.for_day(date(2024, 1, 2)))
    assert [r.trade_id for r in got.collect()] == [2] and "is_best_match" not in got.columns


def test_features_events_and_importances(spark, tmp_path):
    rows = [("X", "A", datetime(2024, 1, d, h), 500, float(h)) for d in (1, 2) for h in range(24 if d == 1 else 23)]
    features = spark.createDataFrame(rows, "exchange string, symbol string, sampled_time timestamp_ntz, window_ms long, asset_return double")
    i.write_features(features, str(tmp_path / "features"))
    bounds = Bounds.for_days(date(2024, 1, 1), date(2024, 1, 3))
    assert i.read_features(spark, str(tmp_path / "features"), bounds).count() == 47
    # The short day is missing as a whole, as is a day without a file.
    wide = i.read_features(spark, str(tmp_path / "features"), Bounds.for_days(date(2024, 1, 1), date(2024, 1, 4)), 24).orderBy("sampled_time").collect()
    assert [r.asset_return for r in wide] == [*map(float, range(24)), *[None] * 48] and wide[25].sampled_time == datetime(2024, 1, 2, 1)
    (tmp_path / "e.json").write_text(json.dumps([{"symbol": "ADA-BTC", "time": "2024-01-01 10:00:00", "exchange": "spot"}]))
    event = i.read_events(spark, str(tmp_path / "e.json")).first()
    assert (event.symbol, event.exchange, event.event_us) == ("ADA-BTC", "SPOT", 1704103200000000)
    i.write_table(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, importance double"), str(tmp_path / "imp"), F.desc("importance"))
    assert [r.feature for r in i.read_importances(spark, str(tmp_path / "imp")).collect()] == ["b", "a"]
    chosen = i.first_features(spark, str(tmp_path / "imp"), 1)
    assert chosen.allows("b") and not chosen.allows("a")


def test_cross_section_has_all_columns(spark, tmp_path):
    day = datetime(2024, 1, 20)
    data = [("X", s, day.date(), k, datetime(2024, 1, 1 + k // 24, k % 24, 30), 10.0 + k % 5, 1.0 + k % 4, k % 3 == 0) for s in "AB" for k in range(24 * 19)]
    ticks = spark.createDataFrame(data, "exchange string, symbol string, date date, trade_id long, trade_time timestamp_ntz, price double, quantity double, is_buyer_maker boolean")
    events = spark.createDataFrame([("e", 1705636800000000)], "event string, event_us long")
    out = pumps.cross_sections(tr.prepared(ticks), events)
    assert len(out.columns) == 3 + 12 * 8 + 5 and out.count() == 2
    i.write_cross_sections(out, str(tmp_path / "cs"))
    assert spark.read.parquet(str(tmp_path / "cs")).count() == 2


def test_streaming_candles_equal_batch(spark, tmp_path):
    data = [("X", "A", k, datetime(2024, 1, 1, k // 6, 10 * (k % 6)), 10.0 + k % 5, 1.0, k % 2 == 0) for k in range(60)]
    ticks = spark.createDataFrame(data, "exchange string, symbol string, trade_id long, trade_time timestamp, price double, quantity double, is_buyer_maker boolean")
    ticks.write.parquet(str(tmp_path / "in"))
    stream = candles(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("candles").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {r.start: tuple(r) for r in candles(ticks).collect()}
    got = {r.start: tuple(r) for r in spark.table("candles").collect()}
    assert len(got) == 9 and all(batch[k] == v for k, v in got.items())
