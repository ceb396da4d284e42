"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Documents become token pieces of at most one sequence. Full pieces are sequences of their own. The others are dealt to groups by
hash; each group runs best-fit decreasing and compares its bins with a lower bound from dual feasible functions. What a bound
certifies stays, but for the group's emptiest bin; a group with a gap also gives up its emptiest bins, four for each bin of the gap.
Given-up documents are dealt anew, to as many groups as their number asks for, and packed again. Rounds end when one group is left or when
a round saves next to nothing, so no group of any round has more than about `group_rows` documents, whatever the corpus and its gaps.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_texts, cut, mapped, tasks_for

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
#: Rows of a group, in every round.
GROUP_ROWS = 50_000
#: A round that saves a smaller share than this of the bins it was given is the last.
LEAST_GAIN = 0.001
#: Entries of a worker's word cache, which a partition's end empties.
CACHE_ENTRIES = 400_000
#: Words that share a call of the tokenizer.
_SHARED = 256
#: Rows and bytes that are encoded at once.
_CHUNK_ROWS, _CHUNK_BYTES = 1000, 4 << 20

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class _Grown:
    """A numpy array that is added to at its end."""

    def __init__(self, dtype: str) -> None:
        self._held, self.size = np.zeros(1 << 12, dtype), 0

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self._held):
            self._held = np.concatenate((self._held[: self.size], np.zeros(max(need, 2 * self.size) - self.size, self._held.dtype)))
        self._held[self.size : need] = values
        self.size = need

    @property
    def values(self) -> np.ndarray:
        return self._held[: self.size]


class WordCache:
    """The ids of words, all in one array. When it is full it begins anew."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]]) -> None:
        self._encode = encode
        self.clear()

    def clear(self) -> None:
        self._row: dict[str, int] = {}
        self.ids, self.starts, self.sizes = _Grown("<u4"), _Grown("i8"), _Grown("i4")

    def rows(self, words: list[str]) -> np.ndarray:
        """The rows of distinct words in starts and sizes."""
        if len(self._row) > CACHE_ENTRIES:
            self.clear()
        out = np.fromiter(map(self._row.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new, ids, sizes = self._encode([words[k] for k in missing.tolist()])
            self._row.update(zip(new, range(self.sizes.size, self.sizes.size + len(new)), strict=True))
            self.starts.add(self.ids.size + np.cumsum(sizes) - sizes)
            self.sizes.add(sizes)
            self.ids.add(ids)
            out[missing] = np.fromiter(map(self._row.__getitem__, (words[k] for k in missing.tolist())), np.int64, len(missing))
        return out


class Encoder:
    """Byte-level BPE of whole texts, word by word through a cache.

    The tokenizer's own pre-tokenizer starts a new token at a space that follows anything but white space, and looks no
    further back; so a text is the concatenation of its words, each but the first with the space before it. A text where a space
    stands between other white space goes to the tokenizer whole. The tokenizer's added tokens hold no space and so lie within words.
    """

    _RUN = re.compile(r"\s \s")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab()
        self._after_space = np.zeros(max(vocabulary.values()) + 1, bool)
        self._after_space[[i for token, i in vocabulary.items() if token[0] == "\u0120"]] = True  # how byte-level BPE writes a space
        self._first, self._later = WordCache(self._alone), WordCache(self._after)

    def clear(self) -> None:
        self._first.clear()
        self._later.clear()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        batch = getattr(self._tokenizer, "encode_batch_fast", self._tokenizer.encode_batch)
        return [np.array(x.ids, "<u4") for x in batch(texts, add_special_tokens=False)]

    def _alone(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words that begin a text."""
        found = self._encode(words)
        return words, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _after(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words after a space. Many share a call: only a word's first token starts with a space."""
        odd = [w for w in words if not w or w[0].isspace()]
        plain = [w for w in words if w and not w[0].isspace()] if odd else words
        ids = np.concatenate([np.zeros(0, "<u4"), *self._encode([" " + " ".join(plain[a : a + _SHARED]) for a in range(0, len(plain), _SHARED)])])
        sizes = np.diff(np.append(np.flatnonzero(self._after_space[ids]), len(ids)))
        if odd:
            alone = self._encode([" " + w for w in odd])
            ids, sizes = np.concatenate([ids, *alone]), np.concatenate([sizes, np.fromiter(map(len, alone), np.int64, len(alone))])
        return [*plain, *odd], ids, sizes

    @staticmethod
    def _odd(held: pa.Array, words: list[str]) -> np.ndarray:
        """Which words are empty or begin with white space. Those that begin with a visible ASCII character aren't looked at."""
        offsets = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)
        out = offsets[1:] == offsets[:-1]
        full = np.flatnonzero(~out)
        first = data[offsets[full]]
        for k in full[(first <= 32) | (first >= 127)].tolist():
            out[k] = words[k][0].isspace()
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (none of them null) as little-endian unsigned 32-bit integers.

        Texts are split and their distinct words numbered in Arrow; only those become Python objects.
        """
        split = pc.split_pattern(texts, " ")
        bounds, coded = split.offsets.to_numpy().astype(np.int64), split.values.dictionary_encode()
        number, words = coded.indices.to_numpy().copy(), coded.dictionary.to_pylist()
        n, whole = len(words), {}
        odd = self._odd(coded.dictionary, words)
        for k in np.unique(np.searchsorted(bounds, np.flatnonzero(odd[number]), side="right") - 1).tolist():
            text = texts[k].as_py()
            if self._RUN.search(text):
                whole[k] = self._encode([text])[0].tobytes()
                number[bounds[k] : bounds[k + 1]] = n
        # A word's ids differ where it begins a text.
        heads = bounds[:-1]
        initial = np.unique(number[heads])
        initial = initial[initial < n]
        later = np.ones(len(number), bool)
        later[heads] = False
        needed = np.zeros(n + 1, bool)
        needed[number[later]] = True
        needed = np.flatnonzero(needed[:n])
        place = {}
        for name, cache, used in (("first", self._first, initial), ("later", self._later, needed)):
            rows = np.zeros(n + 1, np.int64)
            rows[used] = cache.rows([words[k] for k in used.tolist()])
            place[name] = rows
        size, start = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        held = self._later
        here = np.flatnonzero(later & (number < n))
        rows = place["later"][number[here]]
        size[here], start[here] = held.sizes.values[rows], held.starts.values[rows]
        here = heads[number[heads] < n]
        rows = place["first"][number[here]]
        size[here], start[here] = self._first.sizes.values[rows], held.ids.size + self._first.starts.values[rows]
        ids = np.concatenate((held.ids.values, self._first.ids.values))
        ends = np.concatenate(([0], np.cumsum(size)))
        out = ids[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        for k, (a, b) in enumerate(zip(ends[heads].tolist(), ends[bounds[1:]].tolist(), strict=True)):
            yield whole[k] if k in whole else out[a:b].tobytes()


@functools.lru_cache(1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """PIECES of every document: its ids and then end_id, cut so that all pieces but the first are full.

    Null and empty texts are one piece of end_id alone; null ids stay null; a repeated row gives its pieces each time; an empty table gives none.
    A text of any length is encoded whole. tokenizer: a path that exists on every executor.
    """
    path = tokenizer or default_tokenizer()
    end = int(end_id).to_bytes(4, "little")

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column(0).to_pylist(), []
        texts = pc.fill_null(batch.column(1), "")
        for doc_id, coded in zip(ids, _encoder(path).encode(texts), strict=True):
            coded += end
            n, start, k = len(coded) // 4, 0, 0
            length = n % capacity or capacity
            while start < n:
                rows.append((doc_id, k, start, length, zlib.crc32(coded[4 * start : 4 * (start + length)])))
                start, k, length = start + length, k + 1, capacity
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(as_texts(docs), chunk, PIECES, rows=_CHUNK_ROWS, most=_CHUNK_BYTES, done=lambda: _encoder(path).clear())


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of two families of dual feasible functions, over all their parameters."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    below, sums = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(count * x)))
    lam = np.arange(0, capacity // 2 + 1)
    # Over capacity - lam: a whole bin; under lam: nothing; else the length itself.
    large = (below[-1] - below[capacity - lam + 1]) * capacity
    middle = sums[capacity - lam + 1] - sums[lam]
    best = int(-(-(large + middle).max() // capacity))
    for k in range(1, 101):
        # Exact multiples of 1/(k+1) keep their length; others fall to the next multiple of 1/k below (k+1) times it.
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, int(-(-int((value * count).sum()) // (capacity * k))))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit in the order given: the bin and offset of each length, and what is left in each bin."""
    left: list[int] = []
    by_left: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_bins = 0  # bit r is set when some bin has r left
    bins, offsets = [], []
    for n in lengths:
        fits = open_bins >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_left[r].pop()
            if not by_left[r]:
                open_bins ^= 1 << r
        else:
            r, b = capacity, len(left)
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - r)
        left[b] = r - n
        by_left[r - n].append(b)
        open_bins |= 1 << (r - n)
    return bins, offsets, left


def pack_group(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Packs one group; adds bin, offset and open (given up to a further round)."""
    rows = rows.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable")
    lengths = rows["length"].to_numpy(np.int64)
    bins, offsets, left = best_fit(lengths.tolist(), capacity)
    gap = len(left) - lower_bound(lengths, capacity)
    emptiest = np.argsort(-np.array(left), kind="stable")[: 1 + 4 * gap]
    given = np.zeros(len(left), bool)
    given[[b for b in emptiest if left[b]]] = True
    return rows.assign(bin=bins, offset=offsets, open=given[bins])


def _settler(capacity: int, level: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        g = int(rows["g"].iloc[0])
        out = pack_group(rows, capacity)
        out["sequence_id"] = (level << 56) + (g << 24) + out["bin"]
        return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "g", "open"]]

    return settle


def pack(items: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, least_gain: float = LEAST_GAIN) -> DataFrame:
    """PACKED for every row of PIECES; sequence ids are unique but not consecutive. Runs a job or two for each round.

    Lengths must be from 1 to capacity. Repeated rows and rows with null ids are packed as often as they occur; an empty table gives no rows.
    Equal lengths are ordered by id, so a run gives the same packing for the same groups.
    """
    spark = items.sparkSession
    items = cut(items)
    whole = F.col("length") >= capacity
    done = items.where(whole).select("*", F.expr("monotonically_increasing_id() | (1L << 62)").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest, level, given = items.where(~whole), 0, None
    groups = tasks_for(spark, rest.count(), group_rows)
    while True:
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.lit(level)), F.lit(groups)))
        packed = cut(dealt.groupBy("g").applyInPandas(_settler(capacity, level), PACKED + ", g bigint, open boolean"))
        opens = F.col("open").cast("int")
        n = packed.agg(F.count_if(F.col("offset") == 0).alias("bins"), F.sum(opens).alias("rows"), F.count_if(F.col("open") & (F.col("offset") == 0)).alias("open")).first()
        idle = given is not None and n["bins"] > given * (1 - least_gain)
        if groups == 1 or idle or not n["rows"]:
            return done.unionByName(packed.drop("g", "open"))
        done = done.unionByName(packed.where("not open").drop("g", "open"))
        rest, given = packed.where("open").drop("open", "sequence_id", "offset", "g"), n["open"]
        groups, level = max(1, -(-n["rows"] // group_rows)), level + 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises and packs docs; see pieces() and pack()."""
    return pack(pieces(docs, tokenizer, capacity), capacity)
