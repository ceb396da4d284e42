"""SimHash near-duplicates with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most two bits agree
exactly in one segment (pigeonhole), and in one of the other two segments they differ in at most one bit. So for every
ordered pair of segments (S, T), the exact value of S is joined with a fuzzy key of T: T is zero-padded to 23 bits and decoded
by the perfect binary Golay code, whose balls of radius 3 tile the space, to the index of its codeword. One side of the join
carries the index of T itself, the other the indices of T and of all its one-bit neighbours - one or a few, as most neighbours
share a codeword. Candidates are verified on the fingerprints.

Documents with the same fingerprint are one node before anything is joined, so groups of copies don't multiply.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import byte_texts, cut, keep_one, mapped, text_key
from tickloom.llm.components import components

SEGMENTS = (22, 21, 21)
MAX_DISTANCE = 2
SEED = 42
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1. A fixed value.
GOLAY = 0b110001110101

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of the text's word shingles, each hashed with XXH64; zero without words."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        n = len(words) - size + 1
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[a : a + (1 << 14)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _prints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp bigint holding the 64 bits) for each row; null and empty texts give zero. key tells rows of one id apart by their text."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = np.array([fingerprint(x) for x in byte_texts(batch)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got)], ["doc_id", "key", "fp"])

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    return mapped(keyed, chunk, "doc_id bigint, key bigint, fp bigint")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint holding the 64 bits) for each row; null and empty texts give zero."""
    return _prints(docs).select("doc_id", "fp")


def _remainder(words: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: their remainder by the generator."""
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ GOLAY << bit - 11, r)
    return r


@functools.cache
def _leaders() -> np.ndarray:
    """By syndrome, the one error pattern of weight 3 or less."""
    bits = [0, *(1 << i for i in range(23))]
    patterns = np.unique([a | b | c for a in bits for b in bits for c in bits])
    out = np.zeros(2048, np.int64)
    out[_remainder(patterns)] = patterns
    return out


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word: its 12 information bits."""
    return (words ^ _leaders()[_remainder(words)]) >> 11


@functools.cache
def _errors() -> np.ndarray:
    """By syndrome, the error patterns of weight 4 or less, lightest first; -1 where there are fewer than six."""
    patterns = np.array([sum(c) for weight in range(5) for c in itertools.combinations([1 << i for i in range(23)], weight)])
    out, n = np.full((2048, 6), -1), np.zeros(2048, np.int64)
    for syndrome, pattern in zip(_remainder(patterns).tolist(), patterns.tolist(), strict=True):
        out[syndrome, n[syndrome]] = pattern
        n[syndrome] += 1
    return out


def codeword_lists(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within four bits of each 23-bit word, in a last axis of six: one or six, the nearest first, and -1."""
    errors = _errors()[_remainder(words)]
    return np.where(errors < 0, -1, (words[..., None] ^ errors) >> 11)


def segment_keys(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each segment: its values, its codeword index, and the indices of it and its one-bit neighbours, a column each."""
    values, own, near, shift = [], [], [], 64
    for width in SEGMENTS:
        shift -= width
        v = (fps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        values.append(v)
        own.append(codeword_index(v))
        near.append(codeword_index(np.stack([v, *(v ^ 1 << i for i in range(width))], axis=1)))
    return values, own, near


def _keyed(fps: DataFrame, probe: bool) -> DataFrame:
    """(key, fp): index keys, or those of all one-bit neighbours too if probe."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy()
        values, own, near = segment_keys(fp)
        keys, rows = [], []
        for a in range(3):
            for b in range(3):
                if a == b:
                    continue
                head = (values[a] << 16) | (3 * a + b)
                if probe:
                    fuzzy = np.sort(near[b], axis=1)
                    fresh = np.concatenate((np.ones((len(fp), 1), bool), fuzzy[:, 1:] != fuzzy[:, :-1]), axis=1)
                    at, column = np.nonzero(fresh)
                    keys.append((head[at] << 12) | fuzzy[at, column])
                    rows.append(fp[at])
                else:
                    keys.append((head << 12) | own[b])
                    rows.append(fp)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(rows))], ["key", "fp"])

    def run(batches):
        yield from (chunk(b) for b in batches if b.num_rows)

    return fps.mapInArrow(run, "key bigint, fp bigint")


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in max_distance (at most 2) bits or fewer. fps: distinct fp."""
    if not 0 <= max_distance <= 2:
        raise ValueError("three segments guarantee two bits at most")
    left, right = _keyed(fps, True).withColumnRenamed("fp", "a"), _keyed(fps, False).withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    other = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
    pairs = left.join(right, "key").where(close | other)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _roots(fps: DataFrame, max_distance: int) -> DataFrame:
    """(fp, root) of distinct fps: equal roots for those reachable over links."""
    found = components(links(fps, max_distance))
    return fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def group(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs: component_id is the smallest doc_id reachable over links.

    Null, empty and blank texts share the fingerprint zero. A repeated doc_id keeps a row for each of its rows. Null ids are no component_id unless there
    is no other. An empty table gives no rows. Texts of any length are read whole; other columns are not read. Runs jobs: the fingerprints are
    written once, and the components take a few rounds.
    """
    prints = cut(fingerprints(docs))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    named = nodes.join(_roots(nodes.select("fp"), max_distance), "fp")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def digest(grouped: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 hex digits, component_id."""
    return grouped.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """docs, but of each component one row: that of the smallest doc_id; see keep_one. All columns of docs stay."""
    prints = cut(_prints(docs))
    return keep_one(docs, prints.join(_roots(prints.select("fp").distinct(), max_distance), "fp").select("doc_id", F.col("key").alias("fp"), "root"))
