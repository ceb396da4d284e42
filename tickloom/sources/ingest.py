"""Sources and sinks: raw exchange files, partitioned Parquet, event and importance files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.bounds import Bounds
from tickloom.functions.scalar import epoch_to_time
from tickloom.schema import EVENTS_JSON, FUTURES_CSV, IMPORTANCES, SIDED_CSV, SPOT_CSV, FeatureFilter

_DAY = r"@(\d{4}-\d{2}-\d{2})"
#: Schema, header, encoding and whether the file's day decides the time unit, by kind of file.
LAYOUTS = {"spot": (SPOT_CSV, False, "utf-8", True), "futures": (FUTURES_CSV, True, "utf-8", False), "sided": (SIDED_CSV, True, "windows-1252", False)}
#: Rows of a batch that a zip reader hands on.
ZIP_ROWS = 200_000


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: Columns of raw rows that ticks need.
_NEEDED = ("symbol", "trade_id", "price", "quantity", "trade_time", "is_buyer_maker", "side")
#: Files and tasks that a day of one instrument is dealt to.
SLOTS = 8


def _of_days(files: DataFrame, bounds: Bounds | None) -> DataFrame:
    """Only files whose name has a day of the bounds. The predicate is on file metadata alone, so other files aren't opened."""
    if bounds is None:
        return files
    day = F.to_date(F.regexp_extract(F.col("_metadata.file_path"), _DAY, 1))
    return files.where(day.between(F.lit(bounds.start.date()), F.lit(bounds.end.date())))


def read_zips(spark: SparkSession, path: str, kind: str, bounds: Bounds | None = None) -> DataFrame:
    """Rows of zipped CSVs with their file's path, of the bounds' days. A zip can't be split, so a task reads one file, in batches, and only the columns
    that ticks need."""
    schema, header, encoding, _ = LAYOUTS[kind]
    names, dtypes = _columns(schema), {"BIGINT": "int64", "DOUBLE": "float64", "STRING": "str", "BOOLEAN": "boolean"}
    kinds = {c.split()[0]: dtypes[c.split()[1]] for c in schema.split(", ")}
    needed = [n for n in names if n in _NEEDED]
    read = ", ".join(c for c in schema.split(", ") if c.split()[0] in needed)

    def run(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in files:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for inner in z.namelist():
                        with z.open(inner) as f:
                            for part in pd.read_csv(f, names=names, header=0 if header else None, encoding=encoding, dtype=kinds, usecols=needed, chunksize=ZIP_ROWS):
                                yield part[needed].assign(path=name)

    files = _of_days(spark.read.format("binaryFile").load(path), bounds)
    return files.select("path", "content").mapInPandas(run, f"{read}, path STRING")


def read_csvs(spark: SparkSession, path: str, kind: str, bounds: Bounds | None = None) -> DataFrame:
    """Rows of plain or gzipped CSVs with their file's path, of the bounds' days."""
    schema, header, encoding, _ = LAYOUTS[kind]
    files = _of_days(spark.read.schema(schema).csv(path, header=header, encoding=encoding), bounds)
    return files.select(*[n for n in _columns(schema) if n in _NEEDED], F.col("_metadata.file_path").alias("path"))


def normalise(raw: DataFrame, kind: str, exchange: str, bounds: Bounds | None = None) -> DataFrame:
    """Ticks from raw rows with their path: .../SYMBOL/trades@YYYY-MM-DD.* or, with a symbol column, trades@YYYY-MM-DD.*.

    Files outside the bounds' days are passed over. Files named for a day of one venue's clock may hold two UTC dates; their date is that of the trade.
    """
    by_day = LAYOUTS[kind][3]
    day = F.to_date(F.regexp_extract("path", _DAY, 1))
    named = raw.withColumn("_day", day)
    if bounds is not None:
        named = named.where(F.col("_day").between(F.lit(bounds.start.date()), F.lit(bounds.end.date())))
    moment = epoch_to_time(F.col("trade_time"), F.col("_day") if by_day else None)
    out = named.withColumn("trade_time", moment).withColumn("exchange", F.lit(exchange))
    if kind == "sided":
        return out.withColumn("date", F.to_date("trade_time")).select("exchange", "symbol", "date", "trade_id", "trade_time", "price", "quantity", "side")
    return out.withColumn("date", F.col("_day")).withColumn("symbol", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).select("exchange", "symbol", "date", "trade_id", "trade_time", "price", "quantity", "is_buyer_maker")


TICK_KEYS = ("exchange", "date", "symbol")


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_ticks(ticks: DataFrame, root: str, compression: str = "gzip") -> None:
    """Adds ticks by exchange, date and symbol: partitions that get rows keep those they have, and a trade id of an instrument's day is there once.

    So daily runs over files that straddle two dates lose nothing, and a rerun leaves no duplicates. The partitions touched, a few a day and instrument, are
    listed on the driver; only they are read again. One shuffle; an instrument's day goes to SLOTS tasks.
    """
    spark = ticks.sparkSession
    held = ticks
    if _exists(spark, root):
        touched = [r.asDict() for r in ticks.select(*TICK_KEYS).distinct().collect()]
        old = spark.read.schema(ticks.schema).parquet(root)
        days = {d: sorted({t["symbol"] for t in touched if (t["exchange"], t["date"]) == d}) for d in {(t["exchange"], t["date"]) for t in touched}}
        wanted = F.lit(False)
        for (exchange, day), symbols in sorted(days.items()):
            wanted = wanted | ((F.col("exchange") == exchange) & (F.col("date") == F.lit(day)) & F.col("symbol").isin(symbols))
        held = old.where(wanted).unionByName(ticks)
    slotted = held.withColumn("_slot", F.pmod(F.xxhash64("trade_id"), F.lit(SLOTS))).repartition(*TICK_KEYS, "_slot")
    once = slotted.dropDuplicates([*TICK_KEYS, "_slot", "trade_id"]).sortWithinPartitions(*TICK_KEYS, "_slot", "trade_time", "trade_id").drop("_slot")
    once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*TICK_KEYS).parquet(root)


def read_ticks(spark: SparkSession, root: str, bounds: Bounds | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Ticks of the bounds and symbols; both prune partitions."""
    df = spark.read.parquet(root)
    if bounds is not None:
        df = df.where(bounds.predicate())
    return df if symbols is None else df.where(F.col("symbol").isin(symbols))


def symbols_in(spark: SparkSession, root: str, bounds: Bounds, ending: str = "") -> DataFrame:
    """Instruments that have partitions in the bounds' days and end with ending."""
    return read_ticks(spark, root, bounds).where(F.col("symbol").endswith(ending)).select("symbol").distinct()


def write_features(features: DataFrame, root: str) -> None:
    keyed = features.withColumn("date", F.to_date("sampled_time"))
    keyed.repartition("exchange", "date", "symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("exchange", "date", "symbol").parquet(root)


def read_features(spark: SparkSession, root: str, bounds: Bounds, rows_per_day: int | None = None) -> DataFrame:
    """Features of the bounds. With rows_per_day every instrument and window has that many rows on every day, at labels from midnight on: a day that is
    missing or has another number of rows is NULL as a whole, so offsets in rows stay offsets in time."""
    df = spark.read.parquet(root).where(F.col("date").between(F.lit(bounds.start.date()), F.lit(bounds.end.date())))
    if rows_per_day is None:
        return df
    keys = ["exchange", "symbol", "window_ms"]
    whole = df.groupBy(*keys, "date").agg(F.count("*").alias("_n")).where(F.col("_n") == rows_per_day).drop("_n")
    step = 86_400_000_000 // rows_per_day
    label = F.timestamp_micros(F.unix_micros(F.col("date").cast("timestamp")) + F.col("_k") * step).cast("timestamp_ntz")
    days = F.sequence(F.lit(bounds.start.date()), F.lit(bounds.end.date()))
    grid = df.select(*keys).distinct().withColumn("date", F.explode(days)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(rows_per_day - 1)))).withColumn("sampled_time", label).drop("_k")
    kept = df.join(whole, [*keys, "date"], "left_semi").withColumn("sampled_time", F.col("sampled_time").cast("timestamp_ntz"))
    return grid.join(kept, [*keys, "date", "sampled_time"], "left").select(*df.columns)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events (event, symbol, exchange, event_us) of a JSON array."""
    raw = spark.read.schema(EVENTS_JSON).option("multiLine", True).json(path)
    moment = F.unix_micros(F.to_timestamp("time", "yyyy-MM-dd HH:mm:ss"))
    return raw.select(F.concat_ws("@", "symbol", "time").alias("event"), F.col("symbol"), F.upper("exchange").alias("exchange"), moment.alias("event_us"))


def write_table(df: DataFrame, path: str, order: Column | None = None) -> None:
    """A small result as one CSV with a header."""
    (df if order is None else df.orderBy(order)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_importances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(IMPORTANCES).option("header", True).csv(path)


def first_features(spark: SparkSession, path: str, use_first: int = 25) -> FeatureFilter:
    """The panel columns that an importance file ranks first; ties go by name."""
    best = read_importances(spark, path).orderBy(F.desc("importance"), "feature").limit(use_first).collect()
    return FeatureFilter.first([r.feature for r in best], use_first)


def write_cross_sections(sections: DataFrame, root: str) -> None:
    sections.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event").parquet(root)


Reader = Callable[[SparkSession, str, str, "Bounds | None"], DataFrame]


def ingest(spark: SparkSession, path: str, root: str, kind: str, exchange: str, bounds: Bounds | None = None, reader: Reader = read_zips) -> None:
    """Raw files of the bounds' days to partitioned ticks; files of other days aren't opened."""
    write_ticks(normalise(reader(spark, path, kind, bounds), kind, exchange, bounds), root)
