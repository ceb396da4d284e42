"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are indexed once, as words, in a generalised suffix automaton. Training documents are streamed
through it; at each word the automaton's state and depth give the longest match that ends there. A match as long as a
window (or as a whole shorter item) marks its words.

The automaton is a function of the benchmark alone, held in flat arrays. It is built in blocks of at most `block_words` item words, one at a time: a
block is shipped to the executors, passed over all documents and dropped before the next is built. A benchmark of one block takes one pass without a
shuffle. A larger one takes a pass for each block, of which only documents with hits are written, and one join by the texts' checksum.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tickloom.llm.common import as_texts, byte_texts, cut, mapped

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Words of a stretch that one lane of the walk takes, besides the overlap of a window.
_LANE = 48

#: Lower-cases A-Z, keeps 0-9, a-z and all non-ASCII bytes, and turns the rest into spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def item_words(text: bytes | None) -> list[bytes]:
    """Normalised words; null has none."""
    return (text or b"").translate(_FOLD).split()


class _Builder:
    """Builds an automaton symbol by symbol. A state's first transition stands in arrays, further ones in a dictionary."""

    def __init__(self) -> None:
        self.link, self.length = array("i", [-1]), array("i", [0])
        self.symbol, self.goal = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}

    def get(self, state: int, c: int) -> int:
        if self.symbol[state] == c:
            return self.goal[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(c, -1)

    def put(self, state: int, c: int, goal: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.goal[state] = c, goal
        else:
            self.more.setdefault(state, {})[c] = goal

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.symbol.append(-1)
        self.goal.append(-1)
        return len(self.length) - 1

    def _reached(self, p: int, c: int, q: int) -> int:
        """The state of the longest match of p followed by c, where q is what c leads to: q, or a copy of it that holds no longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q])
        self.symbol[copy], self.goal[copy] = self.symbol[q], self.goal[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p >= 0 and self.get(p, c) == q:
            self.put(p, c, copy)
            p = self.link[p]
        return copy

    def extend(self, last: int, c: int) -> int:
        """The state of what `last` stands for followed by c."""
        q = self.get(last, c)
        if q >= 0:
            return self._reached(last, c, q)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0:
            q = self.get(p, c)
            if q >= 0:
                self.link[new] = self._reached(p, c, q)
                break
            self.put(p, c, new)
            p = self.link[p]
        return new


def _grouped(pairs: list[tuple[int, ...]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, rows) of the distinct pairs by their first number."""
    rows = np.unique(np.array(pairs, np.int64).reshape(len(pairs), -1), axis=0) if pairs else np.zeros((0, 3), np.int64)
    return np.searchsorted(rows[:, 0], np.arange(n + 1)), rows[:, 1:]


def _expanded(offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `at`, the rows from its offset to the next: (index into at, row)."""
    sizes = offsets[at + 1] - offsets[at]
    of = np.repeat(np.arange(len(at)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(offsets[at], sizes)


@dataclass
class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the items of each window."""

    window: int
    shortest: int
    vocab: dict[bytes, int]
    names: list[str]  # of items, sorted
    keys: np.ndarray  # state * words + word of each transition, sorted
    goal: np.ndarray
    link: np.ndarray
    length: np.ndarray
    #: For a state, the state on its suffix path that holds the substring of `window` words; -1 if it is shorter.
    at_window: np.ndarray
    #: Items by state: of which its window-long substring is part; and whole items shorter than a window that end there, as (words, item).
    holders: tuple[np.ndarray, np.ndarray]
    whole: tuple[np.ndarray, np.ndarray]
    pairs: np.ndarray  # neighbouring words of an item

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int) -> SuffixAutomaton:
        vocab: dict[bytes, int] = {}
        names = sorted({name for name, words in items if words})
        number = {name: k for k, name in enumerate(names)}
        coded = [(number[name], [vocab.setdefault(w, len(vocab)) for w in words]) for name, words in items if words]
        built = _Builder()
        for _, ids in coded:
            last = 0
            for c in ids:
                last = built.extend(last, c)
        n, v = len(built.length), max(len(vocab), 1)
        link, length = np.frombuffer(built.link, np.int32).copy(), np.frombuffer(built.length, np.int32).copy()
        at_window = np.full(n, -1, np.int32)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)] if any(len(ids) < window for _, ids in coded) else []
        holders = []
        long = np.flatnonzero(length >= window)
        for s in long[np.argsort(length[long], kind="stable")].tolist():
            at_window[s] = s if length[link[s]] < window else at_window[link[s]]
        for name, ids in coded:
            s = 0
            for c in ids:
                s = built.get(s, c)
                if at_window[s] >= 0:
                    holders.append((int(at_window[s]), name))
            if len(ids) < window:
                ends[s].append((len(ids), name))
        for s in np.argsort(length, kind="stable").tolist() if ends else []:
            if s and ends[link[s]]:
                ends[s] = ends[s] + ends[link[s]]
        first = np.flatnonzero(np.frombuffer(built.symbol, np.int32) >= 0)
        more = [(s * v + c, q) for s, x in built.more.items() for c, q in x.items()]
        keys = np.concatenate((first * v + np.frombuffer(built.symbol, np.int32)[first], np.array([k for k, _ in more], np.int64)))
        goal = np.concatenate((np.frombuffer(built.goal, np.int32)[first], np.array([q for _, q in more], np.int32)))
        order = np.argsort(keys)
        whole = _grouped([(s, m, name) for s, x in enumerate(ends) for m, name in x], n)
        pairs = np.unique(np.array([a * v + b for _, ids in coded for a, b in zip(ids, ids[1:], strict=False)], np.int64))
        shortest = min((min(len(ids), window) for _, ids in coded), default=0)
        return cls(window, shortest, vocab, names, keys[order], goal[order], link, length, at_window, _grouped(holders, n), whole, pairs)

    def lanes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of codes (-1: no item word, or a document's end) whose neighbouring words are neighbours in an item too, cut into lanes.

        Every match lies in such a stretch, as a walk from the root can't pass a pair that no item has; and every match of up to a window in a lane, as
        lanes overlap.
        """
        known = codes >= 0
        both = np.flatnonzero(known[:-1] & known[1:])
        joined = np.zeros(len(codes), bool)  # joined[i]: i goes with i + 1
        if len(self.pairs):
            key = codes[both].astype(np.int64) * len(self.vocab) + codes[both + 1]
            joined[both] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined[:-1])))
        ends = np.flatnonzero(known & ~joined) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        pieces = -(-(ends - starts) // _LANE)
        of = np.repeat(np.arange(len(starts)), pieces)
        begin = starts[of] + (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _LANE
        return begin, np.minimum(begin + _LANE + self.window - 1, ends[of])

    def follow(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Streams the codes, all lanes at once: hits (start, end exclusive) and finds (place, item), both unmerged."""
        none = np.zeros(0, np.int64)
        if not self.shortest or not len(codes):
            return none, none, none, none
        at, end = self.lanes(codes)
        state, depth = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        hits, finds = [], []
        while len(at):
            key = state * len(self.vocab) + codes[at]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[k] == key
            back = ~on & (state > 0)
            state = np.where(on, self.goal[k], np.where(back, self.link[state], 0))
            depth = np.where(on, depth + 1, np.where(back, self.length[state], 0))
            full = np.flatnonzero(on & (depth >= self.window))
            if len(full):
                place = at[full] + 1
                hits.append((place - self.window, place))
                of, row = _expanded(self.holders[0], self.at_window[state[full]])
                finds.append((place[of] - 1, self.holders[1][row, 0]))
            some = np.flatnonzero(on)
            of, row = _expanded(self.whole[0], state[some])
            if len(of):
                words, item = self.whole[1][row].T
                fits = words <= depth[some][of]
                place = at[some][of][fits]
                hits.append((place + 1 - words[fits], place + 1))
                finds.append((place, item[fits]))
            at = at + ~back
            alive = at < end
            at, end, state, depth = at[alive], end[alive], state[alive], depth[alive]
        start, stop = (np.concatenate(x) for x in zip(*hits)) if hits else (none, none)
        place, item = (np.concatenate(x) for x in zip(*finds)) if finds else (none, none)
        return start, stop, place, item

    def search(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """For each text its number of words, its hit word ranges (disjoint, in order) and the sorted names of the items found."""
        get, parts, sizes = self.vocab.get, [], []
        for text in texts:
            words = item_words(text)
            parts.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
            parts.append(np.full(1, -1, np.int32))
            sizes.append(len(words))
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        n_words = np.array(sizes, np.int64)
        bounds = np.cumsum(n_words + 1) - n_words - 1
        start, stop, place, item = self.follow(codes)
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, stop, -1)
        edge = np.diff(np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False])).astype(np.int8))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        names: list[list[str]] = [[] for _ in texts]
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(bounds, first, side="right") - 1
        for k, a, b in zip(of.tolist(), (first - bounds[of]).tolist(), (last - bounds[of]).tolist(), strict=True):
            spans[k].append((a, b))
        owner = np.searchsorted(bounds, place, side="right") - 1
        for k, name in np.unique(np.stack([owner, item], axis=1), axis=0).tolist():
            names[k].append(self.names[name])
        return n_words, spans, names


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items, streamed to the driver in blocks of bounded size. An item of more words than that is a block of its own."""
    block, held = [], 0
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    for row in named.toLocalIterator():
        words = item_words(None if row.text is None else row.text.encode())
        if not words:
            continue
        if block and held + len(words) > block_words:
            yield block
            block, held = [], 0
        block.append((row.item_id, words))
        held += len(words)
    yield block


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = "array<struct<start:int,end:int>>"


def _spans_array(spans: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans that cover the same positions."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits_by_text(docs: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """(sha, spans, items) of the distinct texts with hits in any block. docs: (doc_id, text). A pass and a written table for each block."""
    union, context = None, docs.sparkSession.sparkContext
    for block in blocks:
        shared = context.broadcast(SuffixAutomaton.build(block, window))

        def pass_over(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = byte_texts(batch)
            _, spans, items = shared.value.search(texts)
            hit = [k for k, x in enumerate(spans) if x]
            columns = [pa.array([hashlib.sha256(texts[k] or b"").digest() for k in hit], pa.binary()), _spans_array([spans[k] for k in hit]), pa.array([items[k] for k in hit], pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["sha", "spans", "items"])

        found = mapped(docs, pass_over, f"sha binary, spans {_SPANS_SQL}, items array<string>")
        found = cut(found.groupBy("sha").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))
        shared.destroy()
        union = found if union is None else union.unionByName(found)

    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [merged([(s["start"], s["end"]) for s in x]) for x in batch.column(1).to_pylist()]
        items = [sorted(set(x)) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), _spans_array(spans), pa.array(items, pa.list_(pa.string()))], ["sha", "spans", "items"])

    gathered = union.groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    return mapped(gathered, merge, f"sha binary, spans {_SPANS_SQL}, items array<string>", "sha")


def _one_or_more(benchmark: DataFrame, block_words: int) -> tuple[list | None, Iterator[list]]:
    """The only block, or None and all blocks."""
    blocks = _blocks(benchmark, block_words)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return first, iter(())

    def all_of() -> Iterator[list]:
        yield first
        yield second
        yield from blocks

    return None, all_of()


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Returns doc_id, n_words, spans (disjoint hit word ranges, in order) and items (sorted item ids) for every row of docs.

    Null and empty texts have no words and no hits; empty items match nothing; a null item_id counts as an empty one; items with the same text are all
    reported, rows that repeat an id as one; a repeated row of docs gives a row each, a null doc_id stays null. An empty table of docs gives no rows, an
    empty benchmark no hits. Texts are read whole, whatever their length. Other columns of either table are not looked at.
    Runs one job to read the benchmark, and one for each block if it has several.
    """
    texts, (only, blocks) = as_texts(docs), _one_or_more(benchmark, block_words)
    schema = f"doc_id bigint, n_words bigint, spans {_SPANS_SQL}, items array<string>"
    if only is not None:
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton.build(only, window))

        def pass_over(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, spans, items = shared.value.search(byte_texts(batch))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), _spans_array(spans), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

        return mapped(texts, pass_over, schema)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = byte_texts(batch)
        shas = [hashlib.sha256(x or b"").digest() for x in held]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(item_words(x)) for x in held], pa.int64()), pa.array(shas, pa.binary())], ["doc_id", "n_words", "sha"])

    hits = _hits_by_text(texts, blocks, window)
    counted = mapped(texts, count, "doc_id bigint, n_words bigint, sha binary").join(hits, "sha", "left")
    return counted.select("doc_id", "n_words", F.expr(f"coalesce(spans, cast(array() as {_SPANS_SQL}))").alias("spans"), F.expr("coalesce(items, cast(array() as array<string>))").alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + (x["end"] - x["start"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without what reaches from each span's first word to its last."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, text[last:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, with the text of every hit span cut out; a document with a larger share of its words hit than max_coverage goes.

    A span is cut from its first word to its last, with what stands between; the rest stays as it is, and a whole number n_chars, if there is one,
    follows the text. Documents without a hit, null and empty texts among them, are returned unchanged, with all columns of docs; repeated rows each. Columns of docs
    may have any names. Empty tables and items as for find_contamination.
    """
    names, (only, blocks) = docs.columns, _one_or_more(benchmark, block_words)
    held = [f"_c{i}" for i in range(len(names))]
    renamed, at = docs.toDF(*held), names.index("text")
    chars = names.index("n_chars") if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, IntegralType) else None
    renamed = renamed.withColumn(held[at], F.col(held[at]).cast("string"))
    fields = renamed.schema

    def cleaned(batch: pa.RecordBatch, n_words: np.ndarray, spans: list[list[tuple[int, int]]]) -> pa.RecordBatch:
        columns, keep = list(batch.columns[: len(held)]), np.ones(batch.num_rows, bool)
        hit = [k for k, x in enumerate(spans) if x]
        if hit:
            texts, sizes = byte_texts(batch, held[at]), columns[chars].to_pylist() if chars is not None else None
            for k in hit:
                keep[k] = sum(b - a for a, b in spans[k]) <= max_coverage * n_words[k]
                texts[k] = _without(texts[k], spans[k])
                if sizes is not None:
                    sizes[k] = len(texts[k].decode())
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if sizes is not None:
                columns[chars] = pa.array(sizes, columns[chars].type)
        return pa.RecordBatch.from_arrays(columns, held).filter(pa.array(keep))

    if only is not None:
        shared = docs.sparkSession.sparkContext.broadcast(SuffixAutomaton.build(only, window))

        def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
            n_words, spans, _ = shared.value.search(byte_texts(batch, held[at]))
            return cleaned(batch, n_words, spans)

        return mapped(renamed, clean, fields, held[at]).toDF(*names)

    def clean_joined(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[(s["start"], s["end"]) for s in x or ()] for x in batch.column(len(held)).to_pylist()]
        texts = byte_texts(batch, held[at])
        return cleaned(batch, np.array([len(item_words(t)) if x else 0 for t, x in zip(texts, spans, strict=True)], np.int64), spans)

    hits = _hits_by_text(renamed.select(F.col(held[at]).alias("text")), blocks, window).select("sha", "spans")
    sha = F.unhex(F.sha2(F.coalesce(held[at], F.lit("")).cast("binary"), 256))
    joined = renamed.withColumn("sha", sha).join(hits, "sha", "left").select(*held, F.col("spans").alias("_spans"))
    return mapped(joined, clean_joined, fields, held[at]).toDF(*names)
