"""Exact substring deduplication with FM-indexes per shard.

A word is removed when a window of 20 words that covers it also starts earlier in the corpus. No shard could hold the corpus, and
matching every document with every shard would be quadratic. So work is dealt by anchors:

1. Every window's least 6-word hash is its anchor; equal windows have equal anchors. Anchors are counted; those that occur once
   can't belong to a repeated window and end here.
2. An anchor's home is the first document that has it, and homes are dealt to shards. Around its anchors, each document sends
   stretches of words to the shards of their homes; a long shared passage has one home and stays one stretch.
3. Each shard builds an FM-index of its home documents' stretches and streams all stretches through it. Matching statistics
   above the threshold, with an occurrence that starts earlier, are removals. A shard with more than twice its share of anchors is salted: its index is
   built in several tasks, each with a part of the stretches.
4. A window whose anchor occurs at home in other surroundings only is still open: its first occurrence is in neither. Open windows, which
   are few and lie at the edges of passages, meet by a 128-bit hash with map-side aggregation; all but those of the first document go. The hash stands
   for the words there: among 10^12 windows two that differ share one with a chance under 10^-14.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import byte_texts, chunks, cut, limit_batches, release
from tickloom.llm.fmindex import FMIndex, earlier_spans

WINDOW = 20
ANCHOR = 6
#: Anchors whose stretches one task indexes and searches.
ANCHORS_PER_TASK = 60_000
_PIECE = 48
#: A repeated anchor's slot, of 2^27, is marked in a table of 16 MB that goes to all tasks, so most of the others aren't dealt out again. More anchors
#: than slots only let more of them through.
_SLOT_BITS, _BLOCK_BITS = 27, 16
#: A shard with fewer anchors than this isn't salted.
_LEAST_SALTED = 2000
_STEP = np.uint64(0x9E3779B97F4A7C15)


_BLOCK_WORDS = 1 << 17
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
#: Multipliers of a multilinear hash, by the byte's place in its word modulo 64.
_PLACES = np.random.default_rng(20).integers(0, 1 << 64, 64, np.uint64) | np.uint64(1)


class Words:
    """The words of some texts: where they start and end in the joined bytes, each text's range of words, and a hash of each word."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"\n" + b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        edge = np.diff(_SPACE[raw].view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
        places = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.bounds = np.searchsorted(self.starts, places)
        parts = [self._hash(raw, a, min(a + _BLOCK_WORDS, len(self.starts))) for a in range(0, len(self.starts), _BLOCK_WORDS)]
        self.hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _hash(self, raw: np.ndarray, a: int, b: int) -> np.ndarray:
        piece = raw[self.starts[a] : self.ends[b - 1]]
        lengths = self.ends[a:b] - self.starts[a:b]
        first = np.cumsum(lengths) - lengths
        letters = piece[~_SPACE[piece]].astype(np.uint64)
        place = np.arange(len(letters)) - np.repeat(first, lengths)
        letters += (place >> 6).astype(np.uint64) * np.uint64(257) + np.uint64(1)
        return _mixed(np.add.reduceat(letters * _PLACES[place & 63], first) + lengths.astype(np.uint64))

    def text(self, a: int, b: int) -> bytes:
        """Words a to b - 1 with what stands between them."""
        return self.data[self.starts[a] : self.ends[b - 1]]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of every `size` consecutive words; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed + 1, np.uint64)
    for k in range(size):
        out = out * _STEP + hashes[k : k + n]
    return _mixed(out)


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over every `size` consecutive values, by doubling."""
    width, out = 1, values
    while width < size:
        step = min(width, size - width)
        out = pick(out[: len(out) - step], out[step:])
        width += step
    return out


def anchors(words: Words, window: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all `size`-word grams, the places of those that are the least of some window of a text, and the least of each window (0 where a window isn't within one text)."""
    grams, reach = rolling(words.hashes, size), window - size + 1
    n = len(words.hashes) - window + 1
    if n <= 0:
        return grams, np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first, last = words.bounds[:-1], words.bounds[1:]
    long = last - first >= window
    within = np.zeros(n + 1, np.int32)
    np.add.at(within, first[long], 1)
    np.add.at(within, last[long] - window + 1, -1)
    least = np.where(np.cumsum(within)[:n] > 0, _sliding(grams, reach, np.minimum), np.uint64(0))
    padded = np.concatenate((np.zeros(reach - 1, np.uint64), least, np.zeros(reach - 1, np.uint64)))
    best = _sliding(padded, reach, np.maximum)  # of the windows that cover each gram
    return grams, np.flatnonzero((best == grams) & (best > 0)), least


def _keyed(docs: DataFrame) -> DataFrame:
    """(id, fp, text): fp tells rows of one id apart by their text, and is 0 where ids are unique."""
    limit_batches(docs.sparkSession)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    repeated = plain.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return plain.select("id", (F.xxhash64("text") if repeated else F.lit(0).cast("bigint")).alias("fp"), "text")


def _slot_table(hashes: DataFrame) -> np.ndarray:
    """A bit for each slot that a hash of (h) has. Gathered by blocks of slots; what reaches the driver is the table."""
    slot = F.shiftrightunsigned("h", 64 - _SLOT_BITS)
    dealt = hashes.select(F.shiftright(slot, _BLOCK_BITS).alias("block"), slot.bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("place"))

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << _BLOCK_BITS, np.uint8)
        bits[rows["place"].to_numpy()] = 1
        return pd.DataFrame({"block": [rows["block"].iat[0]], "bits": [np.packbits(bits).tobytes()]})

    table = np.zeros((1 << _SLOT_BITS - _BLOCK_BITS, 1 << _BLOCK_BITS - 3), np.uint8)
    for row in dealt.groupBy("block").applyInPandas(gather, "block bigint, bits binary").toLocalIterator():
        table[row.block] = np.frombuffer(row.bits, np.uint8)
    return table.ravel()


def _all_anchors(keyed: DataFrame, window: int, size: int, slots: np.ndarray | None = None) -> DataFrame:
    """(h, id, fp, p) of every anchor, or of those whose slot is marked."""
    shared = None if slots is None else keyed.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words = Words(byte_texts(batch))
            grams, at, _ = anchors(words, window, size)
            if shared is not None:
                slot = (grams[at] >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
                at = at[(shared.value[slot >> 3] >> (7 - (slot & 7))) & 1 == 1]
            of = np.searchsorted(words.bounds, at, side="right") - 1
            columns = (grams[at].view(np.int64), batch.column(0).to_numpy()[of], batch.column(1).to_numpy()[of], (at - words.bounds[of]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "id", "fp", "p"])
        release()

    return keyed.mapInArrow(run, "h bigint, id bigint, fp bigint, p int")


def _compressed(keyed: DataFrame) -> DataFrame:
    """(id, fp, z): texts as they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3)
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pack.compress(x) for x in byte_texts(batch)], pa.binary())], ["id", "fp", "z"])

    return keyed.mapInArrow(run, "id bigint, fp bigint, z binary")


_SEGMENT = "shard bigint, salt int, id bigint, fp bigint, start int, home boolean, body binary, asked binary, open binary"


def _segments(texts: DataFrame, window: int, size: int) -> DataFrame:
    """Stretches of words around repeated anchors. texts: (id, fp, z, marks array<struct<p,first,shard,salts>>).

    `asked` has a bit for each window of the stretch that this shard is to settle, `open` for those of them whose anchor's home is another document.
    """
    reach = window - size + 1
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in _SEGMENT.split(", ")]

    def rows(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[tuple]:
        words = Words(texts)
        grams, _, least = anchors(words, window, size)
        ids, fps, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
        of = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        p, first, shard, salts = (x.to_numpy() for x in lists.flatten().flatten())
        place = words.bounds[of] + p
        # The shard that settles each window, and whether the home of its anchor is another document.
        settler, away = np.full(len(least), -1, np.int64), np.zeros(len(least), bool)
        elsewhere = first != ids[of]
        for back in range(reach):
            w = place - back
            ok = (w >= 0) & (w < len(least))
            ok[ok] = least[w[ok]] == grams[place[ok]]
            settler[w[ok]] = shard[ok]
            away[w[ok & elsewhere]] = True
        order = np.lexsort((p, shard, of))
        of, p, place, shard, salts, home = of[order], p[order], place[order], shard[order], salts[order], (first == ids[of])[order]
        fresh = np.concatenate(([True], (np.diff(of) != 0) | (np.diff(shard) != 0) | (np.diff(p) > reach - 1 + window)))
        begin = np.flatnonzero(fresh)
        stop = np.append(begin[1:], len(of)) - 1
        homes = np.logical_or.reduceat(home, begin)
        for x, y, at_home in zip(begin.tolist(), stop.tolist(), homes.tolist(), strict=True):
            d, s, k = int(of[x]), int(shard[x]), int(salts[x])
            low, high = int(words.bounds[d]), int(words.bounds[d + 1])
            a, b = max(low, int(place[x]) - reach + 1), min(high, int(place[y]) + window)
            ident, fp = int(ids[d]), int(fps[d])
            mine, asked = (ident * 2654435761 >> 9) % k, settler[a : b - window + 1] == s
            body = words.text(a, b)
            yield s, mine, ident, fp, a - low, at_home, body, np.packbits(asked).tobytes(), np.packbits(asked & away[a : b - window + 1]).tobytes()
            if at_home:
                # Elsewhere it is indexed only.
                yield from ((s, other, ident, fp, a - low, True, body, None, None) for other in range(k) if other != mine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in chunks(batches, "z"):
            texts = [unpack.decompress(z) for z in batch.column(2).to_pylist()]
            out = list(rows(batch, texts))
            for a in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 4096], strict=True), types, strict=True)], names)

    return texts.mapInArrow(run, _SEGMENT)


_FOUND = "id bigint, fp bigint, a int, b int, open boolean, w1 bigint, w2 bigint"


def _bits(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)


def search_shard(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Settles one shard: removals, and windows that stay open with their 128-bit hashes."""
    rows = rows.drop_duplicates(["id", "fp", "start"]).sort_values(["id", "fp", "start"], kind="stable")
    bodies, opens, home = rows["body"].tolist(), rows["open"].tolist(), rows["home"].to_numpy(bool)
    ids, fps = rows["id"].to_numpy(np.int64), rows["fp"].to_numpy(np.int64)
    split = [body.split() for body in bodies]
    asked, removed = [k for k in range(len(bodies)) if opens[k] is not None], []
    homes = np.flatnonzero(home).tolist()
    number = dict(zip(dict.fromkeys(chain.from_iterable(split[k] for k in homes)), count(1)))
    get = number.get
    coded = {k: np.fromiter(map(get, split[k], repeat(0)), np.int64, len(split[k])) for k in {*homes, *asked}}
    offset = np.concatenate(([0], np.cumsum([len(coded[k]) + 1 for k in homes]))).astype(np.int64)
    opened: list[tuple] = []
    if asked:
        base = np.concatenate(([0], np.cumsum([len(coded[k]) for k in asked]))).astype(np.int64)
        query = np.concatenate([coded[k] for k in asked])
        settled = np.zeros(len(query) + 1, np.int64)  # windows that start here are settled
        if homes:
            gap = np.zeros(1, np.int64)
            index = FMIndex(np.concatenate([x for k in homes for x in (coded[k], gap)]), len(number) + 1)
            rank = np.searchsorted(homes, asked)
            limit = np.concatenate([offset[j] + (np.arange(len(coded[k])) if home[k] else np.zeros(len(coded[k]), np.int64)) for j, k in zip(rank.tolist(), asked, strict=True)])
            cuts = [np.arange(0, len(coded[k]) - window + 1, _PIECE) for k in asked]
            starts = np.concatenate([base[q] + c for q, c in enumerate(cuts)])
            ends = np.minimum(starts + _PIECE + window - 1, np.repeat(base[1:], [len(c) for c in cuts]))
            wanted = np.zeros(len(query), bool)
            for q, k in enumerate(asked):
                wanted[base[q] + window - 1 : base[q + 1]] = _bits(rows["asked"].iat[k], len(coded[k]) - window + 1)
            a, b = earlier_spans(index, query, starts, ends, limit, wanted, window)
            np.add.at(settled, a, 1)
            np.add.at(settled, b - window + 1, -1)
            q = np.searchsorted(base, a, side="right") - 1
            removed += zip(np.array(asked)[q].tolist(), (a - base[q]).tolist(), (b - base[q]).tolist(), strict=True)
        settled = np.cumsum(settled)[:-1] > 0
        met: set[tuple[int, int, bytes]] = set()
        first_of: dict[bytes, int] = {}
        for q, k in enumerate(asked):
            n = len(coded[k]) - window + 1
            again = first_of.setdefault(bodies[k], k) != k  # an equal stretch came earlier, so its open windows did too
            for s in np.flatnonzero(_bits(opens[k], n) & ~settled[base[q] : base[q] + n]).tolist():
                if again:
                    removed.append((k, s, s + window))
                    continue
                name = xxhash.xxh3_128_digest(b" ".join(split[k][s : s + window]))
                key = (int(ids[k]), int(fps[k]), name)
                if key in met:
                    removed.append((k, s, s + window))
                else:
                    met.add(key)
                    opened.append((k, s, s + window, *struct.unpack("<qq", name)))
    done = np.array([(*x, 0, 0, 0) for x in removed] + [(k, a, b, 1, w1, w2) for k, a, b, w1, w2 in opened], np.int64).reshape(-1, 6).T
    start = rows["start"].to_numpy(np.int64)[done[0]]
    return pd.DataFrame({"id": ids[done[0]], "fp": fps[done[0]], "a": done[1] + start, "b": done[2] + start, "open": done[3].astype(bool), "w1": done[4], "w2": done[5]})


def _searcher(window: int):
    def search(rows: pd.DataFrame) -> pd.DataFrame:
        return search_shard(rows, window)

    return search


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, anchors_per_task: int = ANCHORS_PER_TASK) -> tuple[DataFrame, DataFrame]:
    """(keyed docs, (id, fp, a, b) word ranges to remove). Ranges may overlap. Runs jobs; the spans are written once."""
    keyed = _keyed(docs)
    repeated = _all_anchors(keyed, window, anchor).groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    repeated = cut(repeated)
    load = repeated.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-load // anchors_per_task))
    repeated = repeated.withColumn("shard", F.pmod(F.xxhash64("first"), F.lit(shards)))
    fair = max(2 * load / shards, min(_LEAST_SALTED, anchors_per_task))
    salts = repeated.groupBy("shard").agg(F.ceil(F.sum("n") / fair).cast("int").alias("salts"))
    found = _all_anchors(keyed, window, anchor, _slot_table(repeated))
    marked = found.join(repeated.join(salts, "shard").select("h", "first", "shard", "salts"), "h")
    marks = marked.groupBy("id", "fp").agg(F.collect_list(F.struct("p", "first", "shard", "salts")).alias("marks"))
    segments = _segments(_compressed(keyed).join(marks, ["id", "fp"]), window, anchor)
    settled = cut(segments.groupBy("shard", "salt").applyInPandas(_searcher(window), _FOUND))
    opened = settled.where("open")
    first = opened.groupBy("w1", "w2").agg(F.min("id").alias("m"), F.max("id").alias("last")).where("m < last").drop("last")
    late = opened.join(first, ["w1", "w2"]).where("id > m")
    return keyed, settled.where("not open").select("id", "fp", "a", "b").unionByName(late.select("id", "fp", "a", "b"))


def deduplicate(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, anchors_per_task: int = ANCHORS_PER_TASK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row of docs; kept has the words that stay, joined by single spaces.

    Null, empty and blank texts have no words; texts of fewer words than a window lose none. Rows with the same id and text are one document and
    get the same result; rows with the same id and other texts are apart, and neither is the earlier. An empty table gives no rows. Other columns
    don't matter.
    """
    keyed, spans = repeated_spans(docs, window, anchor, anchors_per_task)
    gathered = spans.groupBy("id", "fp").agg(F.collect_list(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in chunks(batches, "z"):
            out = []
            for ident, z, cuts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = unpack.decompress(z).split()
                gone = 0
                if cuts:
                    keep = np.ones(len(words), bool)
                    for c in cuts:
                        keep[c["a"] : c["b"]] = False
                    gone = int(len(words) - keep.sum())
                    kept = b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])
                else:
                    kept = b" ".join(words)
                out.append((None if ident == -(1 << 63) else ident, len(words), gone, kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            columns[3] = columns[3].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept"])

    return _compressed(keyed).join(gathered, ["id", "fp"], "left").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
