import hashlib
import random

import numpy as np

from tickloom.llm import fmindex as f
from tickloom.llm import substring as s


def test_index_finds_all_occurrences():
    rng = np.random.default_rng(3)
    text = rng.integers(0, 5, 400)
    index = f.FMIndex(text, 5)
    for _ in range(300):
        a = int(rng.integers(0, 390))
        pattern = text[a : a + int(rng.integers(1, 9))]
        if (pattern == 0).any():
            continue
        low, high = np.zeros(1, np.int64), np.full(1, index.n)
        for c in pattern[::-1]:
            low, high = index.extend(np.array([c]), low, high)
        places = [i for i in range(len(text) - len(pattern) + 1) if (text[i : i + len(pattern)] == pattern).all()]
        assert high[0] - low[0] == len(places)
        assert index.earliest(low, high)[0] == places[0]


def test_range_minima_and_size():
    rng = np.random.default_rng(5)
    for n in (1, 15, 16, 17, 400, 5000):
        values = rng.integers(0, 1 << 30, n).astype(np.int32)
        minima = f.RangeMinima(values)
        low = rng.integers(0, n, 500)
        high = np.minimum(low + 1 + rng.integers(0, rng.choice([3, 40, 4000], 500)), n)
        assert minima.least(low, high).tolist() == [values[a:b].min() for a, b in zip(low, high, strict=True)]
    index = f.FMIndex(rng.integers(1, 5000, 200_000), 5000)
    assert index.nbytes < 16 * 200_000


def brute(docs, window):
    first, out = {}, {}
    split = {d: (t or "").encode().split() for d, t in docs}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), (d, i))
    for d, words in split.items():
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (d, i):
                gone |= set(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["the", "É", "of", "x"] + [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passages = [text(n) for n in (7, 8, 9, 12, 30, 60)] + [["a"] * 30, ["a", "b"] * 10]
    docs = [(-3, None), (-2, ""), (-1, " \n ")]
    for k in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice([text(rng.randint(0, 15)), rng.choice(passages), rng.choice(passages)[2:], rng.choice(passages)[:-3]])
        docs.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    for k in range(60, 90):
        words = (docs[3 + k % 40][1] or "").split()
        if words and k % 3:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((k, " ".join(words)))
    return docs


def test_matches_brute_force(spark):
    for seed, window, anchor, per_task in ((1, 8, 3, 60_000), (2, 8, 2, 40), (3, 12, 5, 15), (4, 20, 6, 60_000)):
        docs = corpus(seed)
        frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as id", "2 as n").repartition(3)
        got = {r.doc_id: tuple(r)[1:] for r in s.digest(s.deduplicate(frame, window, anchor, per_task)).collect()}
        assert got == brute(docs, window)
        assert sum(x[1] for x in got.values()) > 200


def test_repeated_rows_and_empty(spark):
    passage = " ".join(f"v{i}" for i in range(25))
    docs = spark.createDataFrame([(1, passage), (1, passage), (2, passage + " tail"), (3, "short"), (None, passage)], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed, r.kept) for r in s.deduplicate(docs).collect())
    assert got == [(-1, 0, passage), (1, 25, ""), (1, 25, ""), (2, 25, "tail"), (3, 0, "short")]
    assert s.deduplicate(docs.limit(0)).count() == 0
