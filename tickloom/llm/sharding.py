"""K-d tree sharding with distributed weighted medians; DataFrame functions only.

Documents are points in metadata space, weighted by their bytes. Each node of the tree is split along its widest dimension where
the bytes on the two sides stand as the leaves that are to come of them; splitting ends at one leaf for each shard. Medians are exact: a
row's key is its coordinate followed by the checksum of its text, and a radix search narrows the median's key by sixteen bits
a round, for all nodes of a level at once: sums by digit, running sums over a node's digits, the digit where the target is reached. So no rows are
sorted or gathered, and nothing that grows with the nodes reaches the driver. A node is named by its first shard, so a row's node and the number of its
leaves are all the state there is; it is written once a level.

Equal texts take the least coordinates of their group, so they share a key and stay together, unless their group is more than `tolerance` of a leaf:
such a group is divided by a hash of the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from tickloom.llm.common import cut, tasks_for

DIMENSIONS = ("lang", "n_chars")
_DIGIT = 16
_COORDINATE_BITS, _TIE_BITS = 31, 31
TOLERANCE = 0.01
_ROWS_PER_SLOT_BUCKET = 100_000
#: Rows up to which a table of nodes, cuts or groups is broadcast: 40 MB. Beyond, no node has more than a small share of the rows, and tables are joined by key.
BROADCAST_ROWS = 500_000


def _small(table: DataFrame, n: int) -> DataFrame:
    return F.broadcast(table) if n <= BROADCAST_ROWS else table


def _value(name: str, schema: StructType) -> Column:
    """A dimension as a number: numbers on a log scale, others by a checksum. Null and NaN are 0."""
    column = F.col(f"`{name}`")
    if isinstance(schema[name].dataType, NumericType):
        number = F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))
        return F.signum(number) * F.log1p(F.abs(number))
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0)).cast("double")


def _points(docs: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """(doc_id, size, text_crc32, tie, k0, k1, ...), written once; from here on texts aren't read."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"v{i}" for i in range(len(dims))]
    raw = cut(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            *[_value(d, docs.schema).alias(v) for d, v in zip(dims, names, strict=True)],
        )
    )
    if dims:
        # Groups of equal texts whose rows differ in a dimension.
        bounds = [f(v).alias(f"{f.__name__}_{v}") for v in names for f in (F.min, F.max)]
        differs = " or ".join(f"min_{v} < max_{v}" for v in names)
        apart = cut(raw.groupBy("text_crc32", "size").agg(*bounds).where(differs).select("text_crc32", "size", *[f"min_{v}" for v in names]))
        raw = raw.join(_small(apart, apart.count()), ["text_crc32", "size"], "left").withColumns({v: F.coalesce(f"min_{v}", v) for v in names})
    ends = raw.agg(F.count("*"), *[f(v).alias(f"{f.__name__}_{v}") for v in names for f in (F.min, F.max)]).first()
    keys = []
    for i, v in enumerate(names):
        low, high = ends[f"min_{v}"] or 0.0, ends[f"max_{v}"] or 0.0
        scaled = F.floor((F.col(v) - low) / ((high - low) or 1.0) * ((1 << _COORDINATE_BITS) - 1)).cast("bigint")
        keys.append((F.shiftleft(scaled, 32) + F.col("text_crc32")).alias(f"k{i}"))
    tie = F.pmod(F.xxhash64("doc_id"), F.lit(1 << _TIE_BITS))
    return raw.select("doc_id", "size", "text_crc32", tie.alias("tie"), *(keys or [F.col("text_crc32").alias("k0")]))


def _weighted_cut(rows: DataFrame, targets: DataFrame, n: int, bits: int) -> DataFrame:
    """For each of n nodes the least key (at) up to which the sizes reach its target, the sum before it and the sum at it (here).

    rows: (node, key, size); targets: (node, target), no more than the node's total. A small table is written for each digit.
    """
    state = targets.select("node", "target", F.lit(0).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("before"))
    for shift in range((bits - 1) // _DIGIT * _DIGIT, -1, -_DIGIT):
        above = F.lit(0).cast("bigint") if shift + _DIGIT >= bits else F.shiftright("key", shift + _DIGIT)
        near = rows.join(_small(state, n), "node").where(above == F.col("at"))
        digit = F.shiftright("key", shift).bitwiseAND(F.lit((1 << _DIGIT) - 1)).alias("digit")
        sums = near.groupBy("node", "target", "at", "before", digit).agg(F.sum("size").alias("here"))
        running = F.sum("here").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
        # Sizes are positive, so one digit of a node takes the running sum to its target.
        reached = sums.withColumn("sum", F.col("before") + running).where("sum >= target and sum - here < target")
        state = cut(reached.select("node", "target", (F.shiftleft("at", _DIGIT) + F.col("digit")).alias("at"), (F.col("sum") - F.col("here")).alias("before"), "here"))
    return state


def _split_level(rows: DataFrame, n_dims: int, tolerance: float) -> tuple[DataFrame, int]:
    """Cuts (node, dim, at, at_tie) of all nodes with more than one leaf, and their number: up to the cut goes left."""
    spans = [(F.max(f"k{i}") - F.min(f"k{i}")).alias(f"span{i}") for i in range(n_dims)]
    sized = rows.where("leaves > 1").groupBy("node", "leaves").agg(F.sum("size").alias("total"), *spans)
    widest = F.greatest(*[F.col(f"span{i}") for i in range(n_dims)]) if n_dims > 1 else F.col("span0")
    dim = F.coalesce(*[F.when(F.col(f"span{i}") == widest, i) for i in range(n_dims)])
    plan = cut(sized.select("node", "leaves", "total", dim.alias("dim"), F.expr("ceil(total * (leaves div 2) / cast(leaves as double))").cast("bigint").alias("target")))
    n = plan.count()
    key = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k{i}")) for i in range(n_dims)])
    keyed = rows.select("node", "size", "tie", *[f"k{i}" for i in range(n_dims)]).join(_small(plan.select("node", "dim"), n), "node").select("node", "size", "tie", key.alias("key"))
    found = _weighted_cut(keyed, plan, n, _COORDINATE_BITS + 32).join(plan.select("node", "leaves", "total", "dim"), "node")
    # The side of the cut key's rows: the nearer one, or both if they are many.
    found = cut(found.withColumn("many", F.col("here") > F.lit(tolerance) * F.col("total") / F.col("leaves")))
    whole = found.where("not many").select("node", "dim", "at", F.expr(f"if(2 * (target - before) >= here, {1 << _TIE_BITS}L, -1L)").alias("at_tie"))
    inner = found.where("many").select("node", "at", (F.col("target") - F.col("before")).alias("target"))
    n_inner = inner.count()
    if not n_inner:
        return whole, n
    same = keyed.join(_small(inner.select("node", "at"), n_inner), "node").where("key = at").select("node", "size", F.col("tie").alias("key"))
    ties = _weighted_cut(same, inner, n_inner, _TIE_BITS).select("node", F.expr("if(2 * (target - before) >= here, at, at - 1)").alias("at_tie"))
    return whole.unionByName(found.select("node", "dim", "at").join(ties, "node")), n


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DIMENSIONS, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of docs; shard from 0, slot gapless from 0 within a shard.

    Give n_shards, or target_bytes to have as many as bring leaves to about that size. Sizes are UTF-8 bytes plus 1 (null texts:
    1). Dimensions that docs lacks are passed over; null values count as 0. Rows with the same id and text are told apart by their slots, null ids are
    kept. An empty table gives no rows; with fewer rows than shards some shards stay empty. A text of any length is one row. Runs a few jobs for each
    level; rows, without texts, are written once a level.
    """
    dims = tuple(d for d in dims if d in docs.columns)
    points = _points(docs, dims)
    n_dims = max(len(dims), 1)
    total = points.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    if n_shards is None:
        if not target_bytes:
            raise ValueError("give n_shards or target_bytes")
        n_shards = max(1, -(-(total["s"] or 0) // target_bytes))
    rows = cut(points.withColumns({"node": F.lit(0).cast("bigint"), "leaves": F.lit(n_shards).cast("bigint")}))
    for _ in range((n_shards - 1).bit_length() if total["n"] else 0):
        cuts, n = _split_level(rows, n_dims, tolerance)
        key = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k{i}")) for i in range(n_dims)])
        right = (key > F.col("at")) | ((key == F.col("at")) & (F.col("tie") > F.col("at_tie")))
        half = F.expr("leaves div 2")
        node = F.when(right, F.col("node") + half).otherwise(F.col("node"))
        leaves = F.when(F.col("dim").isNull(), F.col("leaves")).when(right, F.col("leaves") - half).otherwise(half)
        rows = cut(rows.join(_small(cuts, n), "node", "left").withColumns({"node": node, "leaves": leaves}).drop("dim", "at", "at_tie"))
    return _slotted(rows.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard")), total["n"] or 0)


def _slotted(sharded: DataFrame, n_rows: int) -> DataFrame:
    """Numbers the rows of each shard without gathering a shard: counts of hash buckets give each bucket's first slot."""
    buckets = tasks_for(sharded.sparkSession, n_rows, _ROWS_PER_SLOT_BUCKET)
    dealt = sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return dealt.withColumn("k", F.row_number().over(inside) - 1).join(firsts, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("k")).alias("slot"))


def digest(shards: DataFrame) -> DataFrame:
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
