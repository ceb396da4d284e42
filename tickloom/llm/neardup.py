"""Near-duplicates by SimHash with Golay-code fuzzy hashing, verified by the Jaccard similarity of five-word shingles.

A document's fingerprint is the SimHash of its distinct shingles, of 23-bit segments. A bit of a pair of similarity 0.8 differs with a chance of 0.15, so no segment
need be equal and none within a bit: each is decoded to the list of the Golay codewords within four bits of it, 5.3 on average, and a document is in the bucket of
each. Two segments of such a pair share a bucket with a chance of 0.60, two at random with 0.007; SEGMENTS of them miss a pair with a chance under one in ten
thousand, and less above 0.8. Bits of a few shingles differ more often (0.19 for four shingles of five), so short documents have SHORT_SEGMENTS.
Documents with the same shingles are one node.

In a bucket all fingerprints are held against each other; those that differ in over MOST_BITS_APART bits (FEW_BITS_APART, if one has under FEW shingles) aren't similar,
but for a chance of about one in a hundred thousand at similarity 0.8. The shingles themselves decide. Before texts meet, a pair's sketches do: four bits of each of MIN_HASHES min-hashes. A pair whose sketches differ in over MOST_APART
places isn't similar, but for a chance under one in a hundred thousand at similarity 0.8, and less above.

Of the near nodes of a bucket, each is first tried against one leader, so a large group of near copies costs a link a node. Nodes that are then still near one of another
component are held against each other, by one bit each of FINE min-hashes, as a condition of the join: what passes is tried, so no near pair of a bucket that could join two components stays untried but by
a chance as above, and neither a group of copies nor a crowd of documents that are alike but not similar is made into pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import byte_texts, chunks, cut, keep_one, limit_batches, mapped, release, text_key
from tickloom.llm.components import components
from tickloom.llm.simhash import codeword_lists

SIZE = 5
LEAST_SIMILARITY = 0.8
#: 23-bit segments of a fingerprint; of documents of fewer than SHORT shingles.
SEGMENTS, SHORT_SEGMENTS, SHORT = 11, 16, 64
#: Bits of the first WORDS words of two fingerprints that may differ, a mean of 41 at most at similarity 0.8 and a deviation of 5.9; below FEW shingles 48 and 6.2.
WORDS, MOST_BITS_APART, FEW, FEW_BITS_APART = 4, 68, 8, 76
MIN_HASHES = 120
SEED = 42
#: Places of two sketches that may differ; the mean at similarity 0.8 is 22.5, with a deviation of 4.3.
MOST_APART = 45
#: Min-hashes of nodes that their leaders don't settle, and places of them that may differ: the mean at similarity 0.8 is 205, with a deviation of 13.6.
FINE, MOST_FINE_APART = 2048, 272
#: Partners of one node are dealt to so many tasks.
SALTS = 32
#: Nodes of one key that one task holds against those outside the key's largest component.
CROWD = 5000
_CELLS = 1 << 19

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLACES = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SIZE)], np.uint64)
_SALTS = np.random.default_rng(13).integers(0, 1 << 63, 16, np.uint64)
_POWERS = 1 << np.arange(23)
_FINE_FACTORS = np.random.default_rng(12).integers(0, 1 << 63, FINE, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, MIN_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. Fewer than SIZE words are one shingle, no words none."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    size = min(SIZE, len(h))
    n = len(h) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += h[k : k + n] * _PLACES[k]
    return np.unique(_mix(total))


def min_hashes(found: np.ndarray) -> np.ndarray:
    """MIN_HASHES min-hashes of a set of shingles; all bits are set where there are none."""
    return _least(found, _FACTORS)


def _least(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least, step = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64), _CELLS // len(factors)
    for a in range(0, len(found), step):
        np.minimum(least, (found[a : a + step, None] * factors).min(0), out=least)
    return least


def fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash bits of a set of shingles, WORDS words of them or as many as SHORT_SEGMENTS take: those set in over half of the shingles' further hashes."""
    size = WORDS if len(found) >= SHORT else -(-SHORT_SEGMENTS * 23 // 64)
    ones = np.zeros(64 * size, np.int64)
    for a in range(0, len(found), 255):
        bits = np.unpackbits(_mix(found[a : a + 255, None] ^ _SALTS[:size]).view(np.uint8), axis=1)
        ones += bits.view(np.uint64).sum(0, dtype=np.uint64).view(np.uint8)  # eight counts of up to 255 a word
    return 2 * ones > len(found)


def golay_keys(bits: np.ndarray) -> np.ndarray:
    """Buckets of a fingerprint's segments: number of the segment and index of a Golay codeword."""
    n = SEGMENTS if len(bits) == 64 * WORDS else SHORT_SEGMENTS
    lists = codeword_lists(bits[: 23 * n].reshape(n, 23) @ _POWERS)
    return (lists | np.arange(n)[:, None] << 12)[lists >= 0]


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of a hash of each min-hash, fifteen of them a word."""
    bits = (_mix(least) >> np.uint64(60)).reshape(-1, 15)
    return (bits << (np.arange(15, dtype=np.uint64) * np.uint64(4))).sum(1, dtype=np.uint64)


def fine_sketch(found: np.ndarray) -> np.ndarray:
    """One bit of a hash of each of FINE min-hashes, 64 a word."""
    return np.packbits((_mix(_least(found, _FINE_FACTORS)) >> np.uint64(63)).astype(np.uint8)).view(np.uint64)


def places_apart(a: str, b: str) -> Column:
    """Places in which two sketches differ."""
    terms = []
    for k in range(MIN_HASHES // 15):
        x = f"({a}[{k}] ^ {b}[{k}])"
        pairs = f"({x} | shiftright({x}, 1))"
        terms.append(f"bit_count(({pairs} | shiftright({pairs}, 2)) & 1229782938247303441)")
    return F.expr(" + ".join(terms))


def fine_places_apart(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{k}] ^ {b}[{k}])" for k in range(FINE // 64)))


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST_SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, node, sketch, bits, keys, most) of docs (doc_id, fp, text): node is a hash of the text's shingles, bits the first words of its fingerprint,
    most the bits that another's may differ in, keys its buckets."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, sketches, bits, keys, most = [], [], [], [], []
        for text in byte_texts(batch):
            found = shingles(text)
            node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            sketches.append(sketch(min_hashes(found)))
            print_ = fingerprint(found)
            bits.append(np.packbits(print_[: 64 * WORDS]).view(np.uint64))
            keys.append(golay_keys(print_))
            most.append(MOST_BITS_APART if len(found) >= FEW else FEW_BITS_APART)
        lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel().view(np.int64))) for x in (np.array(sketches), np.array(bits))]
        ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
        lists.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys).astype(np.int32))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), *lists, pa.array(most, pa.int32())], ["doc_id", "fp", "node", "sketch", "bits", "keys", "most"])

    return mapped(docs, chunk, "doc_id bigint, fp bigint, node bigint, sketch array<bigint>, bits array<bigint>, keys array<int>, most int")


def _packed(texts: DataFrame) -> DataFrame:
    """(fp, z) of (fp, text): texts as they are written and shuffled."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(3)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(x or b"") for x in byte_texts(batch)], pa.binary())], ["fp", "z"])

    return mapped(texts, chunk, "fp bigint, z binary")


def _near(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches are near. sketches: (node, sketch)."""
    sides = [sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"s_{c}")) for c in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").where(places_apart("s_a", "s_b") <= MOST_APART).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. texts: (node, z)."""
    limit_batches(pairs.sparkSession)

    def run(batches):
        unpack, last, held = zstandard.ZstdDecompressor(), None, None
        for batch in chunks(batches, "z_b", rows=512):
            good = []
            for x, y in zip(byte_texts(batch, "z_a"), byte_texts(batch, "z_b"), strict=True):
                if last is None or x != last:
                    last, held = x, shingles(unpack.decompress(x))
                good.append(similar(held, shingles(unpack.decompress(y)), least))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        release()

    near = cut(pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))))
    left = near.select("a", "salt").distinct().join(texts.select(F.col("node").alias("a"), F.col("z").alias("z_a")), "a")
    right = near.join(texts.select(F.col("node").alias("b"), F.col("z").alias("z_b")), "b")
    return right.join(left, ["a", "salt"]).select("a", "b", "z_a", "z_b").mapInArrow(run, "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.toDF("x", "y").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _bits_near(bits: np.ndarray, most: np.ndarray, some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether fingerprints, the columns some and others of bits, are near."""
    apart = np.zeros((len(some), len(others)), np.uint16)
    for word in bits:
        apart += np.bitwise_count(word[some, None] ^ word[others])
    return apart <= np.maximum(most[some, None], most[others])


def _sketches_near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches, the columns of a and of b, are near; see places_apart."""
    apart = np.zeros(a.shape[1], np.uint16)
    for x, y in zip(a, b, strict=True):
        pairs = x ^ y
        pairs |= pairs >> np.uint64(1)
        pairs |= pairs >> np.uint64(2)
        apart += np.bitwise_count(pairs & np.uint64(0x1111111111111111))
    return apart <= MOST_APART


def led(bits: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (leader, other) between the columns of bits: one of each that is near any other, and more of leaders."""
    n = bits.shape[1]
    free, start, out = np.ones(n, bool), 0, [(np.zeros(0, np.int64),) * 2]
    while start < n:
        todo = start + np.flatnonzero(free[start:])[: max(1, _CELLS // n)]
        if not len(todo):
            break
        # Those before start that are still free are near no other.
        others = np.concatenate((np.flatnonzero(~free[:start]), np.arange(start, n)))
        near = _bits_near(bits, most, todo, others)
        near &= others != todo[:, None]
        for i in np.flatnonzero(near.any(1)):
            if free[todo[i]]:
                free[todo[i]] = False
                mates = others[near[i]]
                fresh = mates[free[mates]]
                free[fresh] = False
                fresh = fresh if len(fresh) else mates[:1]
                out.append((np.full(len(fresh), todo[i]), fresh))
        start = todo[-1] + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def straddling(bits: np.ndarray, most: np.ndarray, sketches: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which columns of bits and sketches are near one of another part in both."""
    names, sizes = np.unique(part, return_counts=True)
    found, every = np.zeros(len(part), bool), np.arange(len(part))
    outside = np.flatnonzero(part != names[sizes.argmax()])
    step = max(1, _CELLS // len(part))
    for a in range(0, len(outside), step):
        some = outside[a : a + step]
        x, y = np.nonzero(_bits_near(bits, most, some, every) & (part[some, None] != part))
        x = some[x]
        good = _sketches_near(sketches[:, x], sketches[:, y])
        found[x[good]] = found[y[good]] = True
    return found


def _in_buckets(members: DataFrame, run: Callable[[list[np.ndarray]], list[np.ndarray]], schema: str) -> DataFrame:
    """Applies run to the columns of each bucket's rows; key is the first. A bucket is a codeword of a segment, which holds one node in 770 besides its copies' crowd."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(held: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        return [run([np.concatenate(x) for x in zip(*held, strict=True)])] if sum(len(x[0]) for x in held) > 1 else []

    def batch_of(done: list[list[np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = [], []  # pieces of the last bucket; what came of others
        for batch in batches:
            columns = [x.to_numpy() for x in batch.columns]
            ends = [0, *(np.flatnonzero(np.diff(columns[0])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in itertools.pairwise(ends):
                piece = [x[a:b] for x in columns]
                if held and held[-1][0][0] != piece[0][0]:
                    done += rows(held)
                    held = []
                held.append(piece)
            if done:
                yield batch_of(done)
                done = []
        if done := rows(held):
            yield batch_of(done)
        release()

    limit_batches(members.sparkSession)
    return members.repartition("key").sortWithinPartitions("key").mapInArrow(each, schema)


def _members(nodes: DataFrame, *more: Column | str) -> DataFrame:
    """(key, node, most, words of bits, more) of nodes (node, bits, keys, most, more): a row for each bucket."""
    return nodes.select(F.explode("keys").alias("key"), "node", "most", *(F.col("bits")[k].alias(f"w{k}") for k in range(WORDS)), *more)


def _words(columns: list[np.ndarray]) -> np.ndarray:
    return np.array(columns).view(np.uint64)


def _met(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of near nodes: each node that is near another in a bucket, with its leader there. nodes: (node, bits, keys, most)."""

    def run(columns: list[np.ndarray]) -> list[np.ndarray]:
        a, b = led(_words(columns[3:]), columns[2])
        return [columns[1][a], columns[1][b]]

    return _in_buckets(_members(nodes), run, "a bigint, b bigint")


def _straddlers(nodes: DataFrame) -> DataFrame:
    """(key, node) of nodes (node, bits, keys, most, sketch, part) that are near one of another part in the bucket."""

    def run(columns: list[np.ndarray]) -> list[np.ndarray]:
        words = _words(columns[3:-1])
        found = straddling(words[:WORDS], columns[2], words[WORDS:], columns[-1])
        return [columns[0][found], columns[1][found]]

    places = [F.col("sketch")[k].alias(f"s{k}") for k in range(MIN_HASHES // 15)]
    return _in_buckets(_members(nodes, *places, "part"), run, "key int, node bigint")


def _tagged(live: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, node, part), (key, main, n)): the component of each node of a key, and the largest component of each key that has several."""
    tagged = live.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("part"))
    sizes = tagged.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    return tagged, mixed.select("key", F.col("most.part").alias("main"), "n")


def _fine(texts: DataFrame) -> DataFrame:
    """(node, fine) of (node, z)."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        unpack = zstandard.ZstdDecompressor()
        words = np.array([fine_sketch(shingles(unpack.decompress(z))) for z in byte_texts(batch, "z")])
        lists = pa.ListArray.from_arrays(np.arange(0, words.size + 1, words.shape[1], dtype=np.int32), pa.array(words.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "fine"])

    return mapped(texts, chunk, "node bigint, fine array<bigint>", "z")


def _crowds(tagged: DataFrame, mixed: DataFrame, keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes of one key, in different components, whose fine sketches are near. keys: (node, keys).

    One of each pair is outside the key's largest component: a key whose nodes have found each other has few such nodes left. Each of them goes to all
    tasks that have a part of the key's nodes. Of the keys that two nodes share, all of which have several components, the least makes the pair.
    """
    crowd = tagged.join(mixed.select("key", "main", F.ceil(F.col("n") / CROWD).cast("int").alias("salts")), "key")
    crowd = crowd.join(_fine(texts.join(crowd.select("node").distinct(), "node", "left_semi")).join(keys, "node"), "node")
    side = lambda c: [F.col("node").alias(c), F.col("part").alias(f"part_{c}"), F.col("fine").alias(f"f_{c}"), F.col("keys").alias(f"keys_{c}")]
    left = crowd.where("part <> main").select("key", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), *side("x"))
    right = crowd.select("key", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "main", *side("y"))
    # Of two nodes that are both outside, the pair is made once.
    once = (F.col("part_y") == F.col("main")) | (F.col("part_x") < F.col("part_y"))
    near = (F.col("part_x") != F.col("part_y")) & once & (fine_places_apart("f_x", "f_y") <= MOST_FINE_APART) & F.expr("l.key = array_min(array_intersect(keys_x, keys_y))")
    return left.alias("l").join(right.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt")) & near).select("x", "y")


def _grouped(prints: DataFrame, docs: DataFrame, least: float) -> DataFrame:
    """(node, root) of the nodes that have a similar one."""
    nodes = prints.groupBy("node").agg(*(F.first(x).alias(x) for x in ("sketch", "bits", "keys", "most")), F.min("fp").alias("fp"))
    tried = cut(_ordered(_met(nodes)))
    live = tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct()
    wanted = cut(nodes.join(live, "node", "left_semi"))
    packed = _packed(docs.select("fp", "text")).groupBy("fp").agg(F.first("z").alias("z"))  # copies are one row of each task before they are dealt out
    texts = cut(packed.join(wanted.select("node", "fp"), "fp").select("node", "z"))
    found = components(_verified(_near(tried, wanted.select("node", "sketch")), texts, least))
    parts = wanted.join(found, "node", "left").select("node", "bits", "keys", "most", "sketch", F.coalesce("root", "node").alias("part"))
    rest = _ordered(_crowds(*_tagged(cut(_straddlers(parts)), found), wanted.select("node", "keys"), texts)).join(tried, ["a", "b"], "left_anti")
    links = found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_verified(rest, texts, least))
    return components(links)


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text): fp, a hash of the text, tells rows of one id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("fp"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def group(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_id, fp, root) for each row of docs: equal roots for documents reachable over similar pairs; fp is a hash of the text.

    Null, empty and blank texts, which have no shingles, are similar to each other alone. Texts of under five words are one shingle. A repeated row gives
    a row each; an empty table none. Runs jobs: fingerprints, near pairs and their texts are written once.
    """
    keyed = _keyed(docs)
    prints = cut(_prints(keyed))
    found = _grouped(prints, keyed, least)
    return prints.select("doc_id", "fp", "node").join(found, "node", "left").select("doc_id", "fp", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """docs, but of each group of near-duplicates one row: that of the smallest doc_id; see keep_one. All columns of docs stay."""
    return keep_one(docs, group(docs, least))
