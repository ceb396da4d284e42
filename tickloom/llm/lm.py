"""Language-model scoring by context-tree weighting over bytes.

A text is the stream of its words, a space between two, and an end. Bytes are decomposed into eight binary decisions; for each, a
context tree over the `depth` preceding bytes, whatever words they lie in, holds Krichevsky-Trofimov counts at every depth, and the weighting recursion
mixes all depths. After training the tree is frozen: a decision's probability is the mixture along its context path. Before a text's first byte stand ends.

All trees of all depths are functions of the counts of grams (a symbol after its `depth` bytes), so these are what one pass over all documents gathers:
a task merges its own counts, then they are dealt out by their nearest _TOP + 1 context bytes and summed. Each such context's subtree lies in one
partition, sorted, and is weighted there, a block of whole subtrees at a time; what the subtrees add up to by their nearest _TOP bytes, a number that the
alphabet bounds and not the corpus, goes to the driver, which weights the rest. A second pass over the counts gives each gram its probability.

Documents then add up their symbols' probabilities. The commonest grams and words, a fixed number of each, are looked up in broadcast tables; the others
are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import byte_texts, chunks, crc32_of_id, cut, limit_batches, release

DEPTH = 5
COMMON_GRAMS = 1 << 20
COMMON_WORDS = 1 << 18
#: Depths whose nodes the driver weights: at most 256 ** _TOP contexts, a few thousand in text.
_TOP = 2
#: Distinct words, and grams, that a task holds before it hands them on.
_FLUSH_WORDS, _FLUSH_GRAMS = 300_000, 1_500_000
#: Symbols that are coded at once, and grams that are weighted at once (more where one subtree has more).
_SYMBOLS, _BLOCK = 1 << 21, 1 << 18
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"
LN10, LN2 = float(np.log(10.0)), float(np.log(2.0))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_LOWER).split()


def stream(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts (lists of words) with what stands before each; where each text's symbols start, and how many it has."""
    joined, gap = [b" ".join(words) for words in texts], END * (depth - 1)
    sizes = np.fromiter(map(len, joined), np.int64, len(joined)) + 1
    data = np.frombuffer(END * depth + (END + gap).join(joined) + END, np.uint8)
    return data, depth + np.cumsum(sizes + len(gap)) - sizes - len(gap), sizes


def coded(data: np.ndarray, a: int, b: int, depth: int) -> np.ndarray:
    """Grams of places a to b - 1: the `depth` preceding bytes, the nearest highest, and then the symbol."""
    gram = np.zeros(b - a, np.uint64)
    for d in range(1, depth + 1):
        gram = gram << np.uint64(8) | data[a - d : b - d]
    return gram << np.uint64(8) | data[a:b]


def grams_of(texts: list[list[bytes]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the texts' grams: a value for each place, which places are symbols, and where texts start among them (the first may be under way)."""
    data, starts, sizes = stream(texts, depth)
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    inside = np.cumsum(edge[:-1]) > 0
    for a in range(depth, len(data), _SYMBOLS):
        b = min(a + _SYMBOLS, len(data))
        yield coded(data, a, b, depth), inside[a:b], starts - a


def summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, with the sums of n."""
    order = np.argsort(gram, kind="stable")
    gram = gram[order]
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)


def counted(gram: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, with weight times how often each occurs."""
    gram = np.sort(gram)
    first = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.diff(np.append(first, len(gram))) * weight


def count_grams(docs: DataFrame, depth: int) -> DataFrame:
    """(gram, n): how often each gram of docs (text, held_out) occurs in training texts, 0 for those of other texts only. Dealt by the nearest bytes and sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> None:
            held[:] = [summed(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))]

        def rows() -> Iterator[pa.RecordBatch]:
            merged()
            gram, n = held.pop()
            for a in range(0, len(gram), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(gram[a : a + (1 << 17)].view(np.int64)), pa.array(n[a : a + (1 << 17)])], ["gram", "n"])

        for batch in chunks(batches):
            out = batch.column(1).to_pylist()
            texts = [words_of(x) for x in byte_texts(batch)]
            for side in (False, True):
                for gram, inside, _ in grams_of([x for x, o in zip(texts, out, strict=True) if o == side], depth):
                    held.append(counted(gram[inside], 0 if side else 1))
            if sum(len(g) for g, _ in held) > 2 * _FLUSH_GRAMS:
                merged()
                if len(held[0][0]) > _FLUSH_GRAMS:
                    yield from rows()
        if held:
            yield from rows()
        held.clear()
        release()

    limit_batches(docs.sparkSession)
    near = F.shiftrightunsigned("gram", 8 * (depth - _TOP)).alias("near")
    parts = docs.select("text", "held_out").mapInArrow(run, "gram bigint, n bigint").select(near, "gram", "n").repartition("near")
    return parts.groupBy("near", "gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram").select("gram", "n")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5: Stirling's series after a shift by eight."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.zeros_like(y)
    for k in range(8):
        shift += np.log(x + k)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1.0)


@dataclass
class Nodes:
    """Nodes of one depth, by key (context << 8 | bits so far): ln of the weighted probability, the weight of the own estimate, zeros and ones."""

    key: np.ndarray
    log_w: np.ndarray
    own: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    @classmethod
    def weighted(cls, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Nodes:
        """below: ln of the product of the children's weighted probabilities; None for leaves."""
        kt = log_kt(zeros, ones)
        if below is None:
            return cls(key, kt, np.ones(len(key)), zeros, ones)
        log_w = np.logaddexp(kt, below) - LN2
        return cls(key, log_w, np.exp(kt - LN2 - log_w), zeros, ones)

    def above(self) -> Nodes:
        """The nodes of the depth before, whose contexts lack the farthest byte."""
        key, place = np.unique((self.key >> np.uint64(16)) << np.uint64(8) | self.key & np.uint64(255), return_inverse=True)
        add = lambda x: np.bincount(place, x, len(key))
        return Nodes.weighted(key, add(self.zeros), add(self.ones), add(self.log_w))

    def estimate(self, at: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The own estimate of a bit, and whether training saw the node."""
        seen = self.zeros[at] + self.ones[at]
        return (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (seen + 1.0), seen > 0


def subtrees(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, Nodes]]:
    """For each of the eight bits of whole subtrees below depth `top`: the bits' keys, the bit, the mixture from depth top + 1 on, whether training saw
    that depth's node, and the nodes of that depth.

    A context that training never saw gives the estimate of its deepest ancestor that training saw. So for each context the
    probabilities of the 256 symbols sum to one.
    """
    symbol, context = (gram & np.uint64(255)).astype(np.int64), gram >> np.uint64(8)
    for k in range(8):
        prefix, bit = ((1 << k) | (symbol >> (8 - k))).astype(np.uint64), symbol >> (7 - k) & 1
        key, place = np.unique(context << np.uint64(8) | prefix, return_inverse=True)
        nodes = Nodes.weighted(key, np.bincount(place, n * (bit == 0), len(key)), np.bincount(place, n * (bit == 1), len(key)), None)
        mixed, known = nodes.estimate(place, bit)
        for d in range(depth - 1, top, -1):
            nodes = nodes.above()
            place = np.searchsorted(nodes.key, (context >> np.uint64(8 * (depth - d))) << np.uint64(8) | prefix)
            own, seen = nodes.estimate(place, bit)
            share = nodes.own[place]
            mixed, known = np.where(known, share * own + (1 - share) * mixed, own), seen
        yield (context >> np.uint64(8 * (depth - top))) << np.uint64(8) | prefix, bit, mixed, known, nodes


@dataclass
class Top:
    """What the depths up to `top` make of a mixture p from below: slope * p + base, or plain where training saw nothing below. By bit and node."""

    key: np.ndarray
    slope: np.ndarray
    base: np.ndarray
    plain: np.ndarray

    @classmethod
    def weighted(cls, key: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, top: int) -> Top:
        levels = [Nodes.weighted(key, zeros, ones, below)]
        for _ in range(top):
            levels.append(levels[-1].above())
        slope, base, plain = (np.zeros((2, len(key))) for _ in range(3))
        for bit in range(2):
            bits, place = np.full(len(key), bit), np.arange(len(key))
            own, known = levels[0].estimate(place, bits)
            share = levels[0].own
            s, b, p = 1 - share, share * own, own
            for up, nodes in enumerate(levels[1:], 1):
                place = np.searchsorted(nodes.key, (key >> np.uint64(8 * (up + 1))) << np.uint64(8) | key & np.uint64(255))
                own, seen = nodes.estimate(place, bits)
                share = nodes.own[place]
                s, b, p = np.where(known, (1 - share) * s, 0.0), np.where(known, share * own + (1 - share) * b, own), np.where(known, share * own + (1 - share) * p, own)
                known = seen
            slope[bit], base[bit], plain[bit] = s, b, p
        return cls(key, slope, base, plain)

    def scores(self, gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> np.ndarray:
        """ln P(symbol | context) of the grams of whole subtrees."""
        total = np.zeros(len(gram))
        for key, bit, mixed, known, _ in subtrees(gram, n, depth, top):
            at = np.searchsorted(self.key, key)
            total += np.log(np.where(known, self.slope[bit, at] * mixed + self.base[bit, at], self.plain[bit, at]))
        return total


def top_sums(gram: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of whole subtrees: the nodes of depth top, their zeros and ones, and the ln of the product of their children's weighted probabilities."""
    found = []
    for *_, nodes in subtrees(gram, n, depth, top):
        key, place = np.unique((nodes.key >> np.uint64(16)) << np.uint64(8) | nodes.key & np.uint64(255), return_inverse=True)
        found.append((key, *(np.bincount(place, x, len(key)) for x in (nodes.zeros, nodes.ones, nodes.log_w))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _whole_subtrees(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of sorted (gram, n), cut where the context's nearest bytes change."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= _BLOCK:
            gram, n = (np.concatenate(x) for x in zip(*held, strict=True))
            stop = int(np.searchsorted(gram >> np.uint64(shift), gram[-1] >> np.uint64(shift)))
            if stop:
                yield gram[:stop], n[:stop]
            held, size = [(gram[stop:], n[stop:])], len(gram) - stop
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def train(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, n, log_p float): ln P(symbol | context) of each of count_grams' grams, which are read twice."""
    top = _TOP
    shift = 8 * (depth - top)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _whole_subtrees(batches, shift):
            key, zeros, ones, below = top_sums(gram, n, depth, top)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(zeros), pa.array(ones), pa.array(below)], ["key", "zeros", "ones", "below"])
        release()

    parts = grams.mapInArrow(sums, "key bigint, zeros double, ones double, below double")
    rows = parts.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toArrow()
    columns = [rows.column(c).to_numpy() for c in range(4)]
    order = np.argsort(columns[0])
    shared = grams.sparkSession.sparkContext.broadcast(Top.weighted(columns[0][order].astype(np.uint64), *(c[order] for c in columns[1:]), top))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, n in _whole_subtrees(batches, shift):
            log_p = shared.value.scores(gram, n, depth, top).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n), pa.array(log_p)], ["gram", "n", "log_p"])
        release()

    return grams.mapInArrow(score, "gram bigint, n bigint, log_p float")


@dataclass
class Table:
    """Grams and their values in two direct-mapped tables; of grams that share their slots in both only the first is held."""

    bits: int
    keys: list[np.ndarray]
    values: list[np.ndarray]

    _MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

    @classmethod
    def of(cls, gram: np.ndarray, value: np.ndarray) -> Table:
        """gram: distinct, the most wanted first."""
        bits = max(int(2 * len(gram)).bit_length(), 1)
        out = cls(bits, [], [])
        for mix in cls._MIX:
            slot, first = np.unique((gram * mix) >> np.uint64(64 - bits), return_index=True)
            keys, values = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, np.float32)
            keys[slot], values[slot] = gram[first], value[first]
            out.keys.append(keys)
            out.values.append(values)
            rest = np.ones(len(gram), bool)
            rest[first] = False
            gram, value = gram[rest], value[rest]
        return out

    def look_up(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 for grams that aren't held, and where those are."""
        slot = (gram * self._MIX[0]) >> np.uint64(64 - self.bits)
        good = self.keys[0][slot] == gram
        out = np.where(good, self.values[0][slot], np.float32(0)).astype(np.float64)
        missed = np.flatnonzero(~good)
        slot = (gram[missed] * self._MIX[1]) >> np.uint64(64 - self.bits)
        good = self.keys[1][slot] == gram[missed]
        out[missed] = np.where(good, self.values[1][slot], np.float32(0))
        return out, missed[~good]


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, trained, total bigint): how often each distinct word of docs (text, held_out) occurs in training and in all texts. END, which no word equals, counts the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, other = Counter(), Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for counts, used in ((trained, True), (other, False)):
                names, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
                counts.clear()
                for a in range(0, len(names), 1 << 16):
                    part = pa.array(n[a : a + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array(names[a : a + (1 << 16)], pa.binary()), part if used else pa.array(np.zeros(len(part), np.int64)), part], ["word", "trained", "total"])

        for batch in chunks(batches):
            for text, out in zip(byte_texts(batch), batch.column(1).to_pylist(), strict=True):
                counts = other if out else trained
                counts.update(words_of(text))
                counts[END] += 1
                if len(trained) + len(other) > _FLUSH_WORDS:
                    yield from flush()
        yield from flush()
        release()

    limit_batches(docs.sparkSession)
    parts = docs.select("text", "held_out").mapInArrow(run, "word binary, trained bigint, total bigint")
    return parts.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"))


def commonest(rows: DataFrame, of: str, at_most: int) -> DataFrame:
    """The rows whose count `of` reaches some threshold, the least for which they are no more than at_most.

    The threshold comes from a histogram of counts, exact up to 1024 and with 64 steps for each doubling above; no sort and no single task is needed.
    """
    exact = 1024
    step = F.when(F.col(of) < exact, F.col(of)).otherwise(exact + F.floor(64 * F.log2(F.col(of) / float(exact)))).cast("bigint")
    sizes = sorted(((r["step"], r["n"]) for r in rows.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = sizes[0][0] + 1 if sizes else 0, 0
    for at, n in sizes:
        if held + n > at_most:
            break
        least, held = at, held + n
    return rows.where(step >= least)


_PARTIAL = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_bytes bigint, known bigint, base double, log_p double, key binary, n bigint"
_TYPES = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())


def _looked_up(texts: list[list[bytes]], table: Table, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each text's sum over the grams that the table holds; and (text, gram, times) of the others."""
    sums, lacking = np.zeros(len(texts)), []
    for gram, inside, starts in grams_of(texts, depth):
        value, missed = table.look_up(gram)
        value[~inside] = 0
        here = np.flatnonzero((starts < len(gram)) & (np.append(starts[1:], len(gram) + 1) > 0))
        sums[here] += np.add.reduceat(value, np.maximum(starts[here], 0))
        missed = missed[inside[missed]]
        owner = np.searchsorted(starts, missed, side="right") - 1
        lacking.append(np.stack([owner.astype(np.uint64), gram[missed]], axis=1))
    pairs, n = np.unique(np.concatenate(lacking), axis=0, return_counts=True)
    return sums, pairs[:, 0].astype(np.int64), pairs[:, 1], n


def _partial_scores(docs: DataFrame, depth: int, table: Table, common: dict[bytes, int], trained: np.ndarray, n_ends: int) -> DataFrame:
    """For each document a row of sums over its end and what is common, and a row for each distinct other word and gram, by key."""
    shared = docs.sparkSession.sparkContext.broadcast((table, common, trained > 0, np.log10(trained + 0.1)))
    names = [x.split()[0] for x in _PARTIAL.split(", ")]
    end_known, end_base = int(n_ends > 0), float(np.log10(n_ends + 0.1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, is_known, base = shared.value
        for batch in chunks(batches):
            rows, texts = batch.column(0).to_pylist(), [words_of(x) for x in byte_texts(batch)]
            sums, owner, gram, times = _looked_up(texts, held, depth)
            summary, others = [], []
            for row, doc_id, out, words, log_p in zip(rows, batch.column(1).to_pylist(), batch.column(3).to_pylist(), texts, sums.tolist(), strict=True):
                found = np.fromiter(map(place.get, words, repeat(-1)), np.int64, len(words))
                rare = Counter(map(words.__getitem__, np.flatnonzero(found < 0).tolist()))
                found = found[found >= 0]
                n_bytes = sum(map(len, words)) + max(len(words), 1)
                summary.append((row, doc_id, out, len(words) + 1, n_bytes, int(is_known[found].sum()) + end_known, float(base[found].sum()) + end_base, log_p, b" %d" % row, 0))
                others += [(row, w, n) for w, n in rare.items()]
            others += [(rows[k], END + int(g).to_bytes(8, "big"), n) for k, g, n in zip(owner.tolist(), gram.tolist(), times.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*summary, strict=True), _TYPES, strict=True)], names)
            for a in range(0, len(others), 1 << 16):
                row, key, n = zip(*others[a : a + (1 << 16)], strict=True)
                given = {"row": pa.array(row, pa.int64()), "key": pa.array(key, pa.binary()), "n": pa.array(n, pa.int64())}
                yield pa.RecordBatch.from_arrays([given.get(c, pa.nulls(len(row), t)) for c, t in zip(names, _TYPES, strict=True)], names)
        release()

    return docs.select("row", "doc_id", "text", "held_out").mapInArrow(run, _PARTIAL)


def _share(value: Column) -> Column:
    return F.coalesce(F.col("n") * value, F.lit(0.0))


def score(docs: DataFrame, held_out_of: int = 10, depth: int = DEPTH, common_words: int = COMMON_WORDS, common_grams: int = COMMON_GRAMS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability) and bits_per_byte for each row of docs.

    Documents whose crc32(doc_id as text) mod held_out_of is 0 are held out; the model learns from all others. Null ids count as training. Null and empty
    texts are an end alone. Without training documents every count is zero and the trees give each bit 1/2. Repeated rows are learned from and
    scored as often as they occur; an empty table gives no rows; other columns don't matter. Bytes are those of the words, the spaces between and the end.
    depth is from 3 to 6, and the same for every corpus; common_words and common_grams change what is joined, not the scores. Texts are read three times: for
    words, for grams, for scores. Runs jobs: words and grams are written once with counts, grams once with probabilities.
    """
    if not _TOP < depth <= 6:
        raise ValueError("contexts have three to six bytes")
    held = F.coalesce(crc32_of_id(F.col("doc_id")) % held_out_of == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held)
    words = cut(count_words(docs))
    totals = words.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("n"), F.count_if(F.col("trained") > 0).alias("v")).first()
    n, v = totals["n"], totals["v"]
    last = words.where(F.col("word") == F.lit(END)).first()
    n_ends, words = last["trained"] if last else 0, words.where(F.col("word") != F.lit(END))
    grams = cut(train(cut(count_grams(docs, depth)), depth))
    rows = commonest(grams, "n", common_grams).toArrow()
    order = np.argsort(-rows.column(1).to_numpy(), kind="stable")
    table = Table.of(rows.column(0).to_numpy().view(np.uint64)[order], rows.column(2).to_numpy()[order])
    top = commonest(words, "total", common_words).select("word", "trained").toArrow()
    common = {w: k for k, w in enumerate(top.column(0).to_pylist())}
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
    partial = _partial_scores(numbered, depth, table, common, top.column(1).to_numpy().astype(np.float64), n_ends)
    gram_key = F.concat(F.lit(END), F.unhex(F.lpad(F.hex("gram"), 16, "0")))
    values = words.select(F.col("word").alias("key"), "trained", F.lit(None).cast("float").alias("gram_p")).unionByName(grams.select(gram_key.alias("key"), F.lit(None).cast("bigint").alias("trained"), F.col("log_p").alias("gram_p")))
    joined = partial.join(values, "key", "left")
    sums = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.max("n_bytes").alias("n_bytes"),
        F.sum(F.coalesce("known", F.when(F.col("trained") > 0, F.col("n")), F.lit(0))).cast("bigint").alias("n_known"),
        F.sum(F.coalesce("base", _share(F.log10(F.col("trained") + 0.1)))).alias("base"),
        F.sum(F.coalesce("log_p", _share(F.col("gram_p").cast("double")))).alias("log_p"),
    )
    norm = float(np.log10(n + 0.1 * (v + 1)))
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("log_p") / LN10).alias("score"), (-F.col("log_p") / LN2 / F.col("n_bytes")).alias("bits_per_byte"),
    )
