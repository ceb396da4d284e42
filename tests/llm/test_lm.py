import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tickloom.llm import lm

END = b"\n"


class Tree:
    """Sequential context-tree weighting of one binary decision, with the frozen mixture read off."""

    def __init__(self, depth):
        self.depth, self.counts, self.known, self.below = depth, {}, {}, {}

    def learn(self, context, bit):
        for d in range(self.depth + 1):
            self.counts.setdefault(context[:d], [0, 0])[bit] += 1

    def log_kt(self, node):
        a, b = self.counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, node):
        if not self.known:
            for x in sorted(self.counts, key=len, reverse=True):
                below = self.below.get(x, 0.0)
                self.known[x] = self.log_kt(x) if len(x) == self.depth else float(np.logaddexp(self.log_kt(x), below)) - math.log(2)
                if x:
                    self.below[x[:-1]] = self.below.get(x[:-1], 0.0) + self.known[x]
        return self.known[node]

    def predict(self, context, bit, d=0):
        node = context[:d]
        a, b = self.counts.get(node, (0, 0))
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth or context[: d + 1] not in self.counts:
            return own
        share = math.exp(self.log_kt(node) - math.log(2) - self.weighted(node))
        return share * own + (1 - share) * self.predict(context, bit, d + 1)


def brute_scores(train, other, depth):
    trees = {}

    def symbols(words):
        line = b"\n" * depth + b" ".join(words) + b"\n"
        for i in range(depth, len(line)):
            yield line[i - depth : i][::-1], line[i]

    def each(context, symbol):
        for k in range(8):
            yield trees.setdefault((1 << k) | (symbol >> (8 - k)), Tree(depth)), context, symbol >> (7 - k) & 1

    for words in train:
        for context, symbol in symbols(words):
            for tree, c, bit in each(context, symbol):
                tree.learn(c, bit)
    for tree in trees.values():
        tree.counts.setdefault(b"", [0, 0])
    return [sum(math.log10(t.predict(c, b)) for x in symbols(words) for t, c, b in each(*x)) for words in other]


def split(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def corpus():
    rng = random.Random(5)
    vocab = ["the", "then", "on", "É", "a", "Onto", "日"]
    return [(k, rng.choice([None, ""]) if k % 9 == 0 else " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 9)))) for k in range(50)] + [(51, "zebra ze"), (52, "The zebra"), (7, "x")]


def test_scores_match_brute_force(spark):
    docs = corpus()
    out = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    train = [split(t) for d, t in docs if not out[d]]
    counts = Counter(w for ws in train for w in ws)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    expected = []
    for (d, t), s in zip(docs, brute_scores(train, [split(t) for _, t in docs], 3), strict=True):
        c = [counts[w] for w in split(t)] + [len(train)]
        base = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in c)
        expected.append((d, out[d], len(c), sum(x > 0 for x in c), n, round(base, 8), round(s, 8)))
    frame = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, score double")
    for common in (2, 1000):
        got = lm.score(frame, depth=3, common_words=common, common_grams=common).collect()
        assert sorted((*tuple(r)[:5], round(r.base_score, 8)) for r in got) == sorted(x[:6] for x in expected)
        assert np.allclose([r.score for r in sorted(got)], [x[6] for x in sorted(expected)], rtol=1e-5)
        sizes = {(d, len(c)): len(b" ".join(split(t))) + 1 for (d, t), c in zip(docs, [split(t) + [END] for _, t in docs], strict=True)}
        assert all(abs(r.bits_per_byte * sizes[r.doc_id, r.n_tokens] + r.score * math.log2(10)) < 1e-6 for r in got)


def test_depth_is_the_same_at_any_size(spark):
    """A corpus of a few documents and one of twelve times as many words are scored by trees of the same depth, as brute force has them."""
    rng = random.Random(6)
    for n in (6, 72):
        docs = [(k, " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))) for _ in range(25))) for k in range(n)]
        train = [split(t) for d, t in docs if zlib.crc32(str(d).encode()) % 10]
        got = sorted(lm.score(spark.createDataFrame(docs, "doc_id long, text string"), common_grams=64, common_words=8).collect())
        assert np.allclose([r.score for r in got], brute_scores(train, [split(t) for _, t in docs], lm.DEPTH), rtol=1e-5)


def test_blocks_of_whole_subtrees(spark, monkeypatch):
    """Blocks end where a subtree does, so their size doesn't matter."""
    rng = np.random.default_rng(3)
    gram, n = lm.summed(rng.integers(97, 101, (4000, 6), np.uint64) @ (np.uint64(256) ** np.arange(6, dtype=np.uint64))[::-1], np.ones(4000, np.int64))
    batches = [pa.RecordBatch.from_arrays([pa.array(gram[a : a + 50].view(np.int64)), pa.array(n[a : a + 50])], ["gram", "n"]) for a in range(0, len(gram), 50)]
    monkeypatch.setattr(lm, "_BLOCK", 100)
    blocks = list(lm._whole_subtrees(iter(batches), 24))
    assert len(blocks) > 5 and (np.concatenate([g for g, _ in blocks]) == gram).all()
    near = [set((g >> np.uint64(24)).tolist()) for g, _ in blocks]
    assert sum(map(len, near)) == len(set().union(*near))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    line = b" ".join(bytes(rng.integers(97, 100, rng.integers(1, 6)).astype(np.uint8)) for _ in range(200))
    data, starts, sizes = lm.stream([line.split()], 3)
    known, n = np.unique(lm.coded(data, int(starts[0]), int(starts[0] + sizes[0]), 3), return_counts=True)
    for context in (0x0A0A0A, 0x206120, 0x626262, 0x7A7A7A, 0x61627A):
        every = np.uint64(context << 8) + np.arange(256, dtype=np.uint64)
        gram, counts = lm.summed(np.concatenate((known, every)), np.concatenate((n, np.zeros(256, np.int64))))
        key, zeros, ones, below = lm.top_sums(gram, counts, 3, 2)
        order = np.argsort(key)
        score = lm.Top.weighted(key[order], zeros[order], ones[order], below[order], 2).scores(gram, counts, 3, 2)
        assert abs(np.exp(score[np.isin(gram, every)]).sum() - 1) < 1e-9


def test_table_holds_the_first_of_a_slot():
    rng = np.random.default_rng(1)
    gram, value = np.unique(rng.integers(0, 1 << 48, 5000, np.uint64)), rng.random(5000).astype(np.float32)
    rng.shuffle(gram)
    table = lm.Table.of(gram, value[: len(gram)])
    got, missed = table.look_up(np.concatenate((gram, np.array([7, 9], np.uint64))))
    held = np.setdiff1d(np.arange(len(gram)), missed)
    assert {len(gram), len(gram) + 1} <= set(missed.tolist()) and len(missed) < 300 and np.array_equal(got[held], value[held].astype(float))


def test_better_than_the_base_on_held_out(spark, sf):
    rows = lm.score(spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert rows["sum(score)"] > rows["sum(base_score)"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(22, None)], "doc_id long, text string")
    assert lm.score(docs.limit(0)).count() == 0
    assert lm.score(docs).first().n_tokens == 1
