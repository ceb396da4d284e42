"""Shared helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text that one vectorised step of a Python worker handles at once; bounds its memory.
CHUNK_ROWS = 1000
CHUNK_BYTES = 4 << 20
#: Bytes of a record batch that Spark hands a Python worker, about; a single longer row is a batch of its own.
BATCH_BYTES = 3 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession) -> None:
    """Bounds the bytes that Spark hands a Python worker at once, so batches of very long texts don't add up.

    Plans read the setting when they run, after an operator has returned, so it stays in the session. It changes no result, and a value of the
    session's own stands.
    """
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Gives a Python worker's free memory back: workers are used again, by other operators too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, read by Spark's own reader so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators need, as (doc_id bigint, text string); other columns can't clash."""
    limit_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the decimal text of an id, unsigned."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder of spark.checkpoint.dir; the files outlive any executor.

    Spark removes the files when the driver no longer refers to the table if spark.cleaner.referenceTracking.cleanCheckpoints is on. A local master,
    whose executors are the driver's own process, may go without the setting; a cluster may not.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def forget(spark: SparkSession) -> None:
    """Lets Spark remove what loops have left: shuffles, broadcasts and checkpoints go when the driver's garbage is collected, which a small heap puts off."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", rows: int = CHUNK_ROWS, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of record batches, of so many rows and about so many bytes of text at most (one row at least)."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        column, start, n = batch.column(at), 0, batch.num_rows
        while start < n:
            stop, held = start, 0
            offsets = column.slice(start, min(rows, n - start))
            sizes = pc.binary_length(offsets).to_pylist()
            for size in sizes:
                held += size or 0
                if stop > start and held > most:
                    break
                stop += 1
            yield batch.slice(start, stop - start)
            start = stop


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def mapped(df: DataFrame, chunk: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text", rows: int = CHUNK_ROWS, most: int = CHUNK_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """Applies chunk to slices of df's partitions; done is called at a partition's end, before what is free is given back."""
    limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, text, rows, most):
            out = chunk(piece)
            if out is not None and out.num_rows:
                yield out
        piece = out = None
        if done is not None:
            done()
        release()

    return df.mapInArrow(run, schema)


def tasks_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Number of partitions that keeps tasks at about rows_per_task rows, and uses the session's parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task), 1)


#: Rows to drop up to which their keys are broadcast: 16 MB.
BROADCAST_ROWS = 500_000


def text_key(text: Column) -> Column:
    """A hash that tells rows of one id apart by their text; null is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of docs (doc_id, text and any other columns) one row of each group. grouped: (doc_id, fp, root) for each row, fp as text_key gives it.

    A document is an id with a text, so rows that share an id and differ in their texts are apart. The smallest doc_id stays; null ids come last; among texts
    of one id any may stay, the same one in every run; of rows that repeat id and text one stays. All columns of docs stay, whatever their names.
    """
    names, held = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*held)
    keyed = renamed.withColumns({"_id": F.col(held[names.index("doc_id")]).cast("bigint"), "_fp": text_key(F.col(held[names.index("text")]))})
    grouped = cut(grouped)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "fp")).alias("best"))
    kept = best.select(F.col("best.doc_id").alias("_id"), F.col("best.fp").alias("_fp"), F.lit(True).alias("_kept"))
    rows = grouped.groupBy(F.col("doc_id").alias("_id"), F.col("fp").alias("_fp")).agg(F.count("*").alias("_n"))
    same = F.col("l._id").eqNullSafe(F.col("r._id")) & (F.col("l._fp") == F.col("r._fp"))
    # What goes, or repeats: the rest of docs is passed through.
    odd = cut(rows.alias("l").join(kept.alias("r"), same, "left").select("l._id", "l._fp", F.coalesce("_kept", F.lit(False)).alias("_kept"), (F.col("_n") > 1).alias("_repeated")).where("not _kept or _repeated"))
    n = odd.agg(F.count("*").alias("rows"), F.count_if("_kept").alias("repeated")).first()
    small = F.broadcast(odd) if n["rows"] <= BROADCAST_ROWS else odd
    joined = keyed.alias("l").join(small.alias("r"), same, "left").where("_kept is null or _kept").select("l.*", "r._repeated")
    if n["repeated"]:
        joined = joined.where("_repeated is null").unionByName(joined.where("_repeated").dropDuplicates(["_id", "_fp"]))
    return joined.select(*held).toDF(*names)
