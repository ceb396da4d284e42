import random

import corpus_pipeline
import numpy as np

from tickloom.llm import neardup


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    sets, root = {d: plain(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(d for d in root if find(d) == d)


def corpus():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    bases = [[rng.choice(vocab) for _ in range(n)] for n in (2, 4, 5, 60, 120, 300, 900)]
    docs = [(0, None), (1, ""), (2, " \n")]
    for k in range(3, 150):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8, 20])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((k, (" " if k % 2 else "\n").join(words)))
    return docs


def test_near_copies_match_brute_force(spark):
    docs = corpus()
    got = sorted(r.doc_id for r in neardup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == brute(docs) and len(got) < len({frozenset(plain(t)) for _, t in docs})


def test_stage_drops_copies_that_differ_in_many_bits(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").where("doc_id in (1, 255, 2, 56, 643, 770)")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 2, 643]


def test_chain_over_a_hub_that_is_unlike(spark):
    """All pairs that share a key are tried, not only those with the hub."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    docs = [(k, " ".join(words[6 * k : 300 + 6 * k])) for k in range(16)]
    assert [r.doc_id for r in neardup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()] == brute(docs) == [0]


def test_stage_keeps_columns_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string, source string")
    out = neardup.deduplicate(docs)
    assert out.dtypes == docs.dtypes and out.count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    """Of each group one row: ids with two texts, null ids and repeated rows lose nothing else."""
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(40)) for _ in range(4))
    rows = [(5, a), (5, b), (7, b), (7, b), (None, c), (None, c), (9, d), (9, d)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _id int, _fp int")
    got = neardup.deduplicate(docs).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(5, a), (5, b), (0, c), (9, d)]) and got[0]._fp == 2


def test_sketches_bound_what_similar_texts_may_differ_in():
    rng = random.Random(8)
    worst = 0
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        other = list(words)
        for at in rng.sample(range(5, 199), 4):
            other[at] = "x"
        a, b = (neardup.shingles(" ".join(x).encode()) for x in (words, other))
        if neardup.similar(a, b):
            x, y = (neardup.sketch(neardup.min_hashes(s)).view("u8") for s in (a, b))
            f, g = neardup.fine_sketch(a), neardup.fine_sketch(b)
            assert np.bitwise_count(f ^ g).sum() <= neardup.MOST_FINE_APART
            worst = max(worst, sum((int(p) ^ int(q)) >> 4 * k & 15 != 0 for p, q in zip(x, y) for k in range(15)))
    assert 10 < worst <= neardup.MOST_APART


def test_crowd_of_unlike_copies_gives_few_pairs(spark):
    """Documents of one template share keys but aren't similar: nearly all pairs fall within the join."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    docs = []
    for k in range(300):
        words = list(base)
        for at in rng.sample(range(100), 4):
            words[at] = f"x{k}_{at}"
        docs.append((k, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    prints = neardup._prints(neardup._keyed(table)).cache()
    keys = prints.selectExpr("node", "explode(keys) as key")
    shared = keys.selectExpr("key", "node as a").join(keys.selectExpr("key", "node as b"), "key").where("a < b").select("a", "b").distinct().count()
    texts = neardup._packed(neardup._keyed(table).select("fp", "text")).join(prints.select("fp", "node"), "fp").select("node", "z")
    alone = spark.createDataFrame([], "node long, root long")
    passed = neardup._ordered(neardup._crowds(*neardup._tagged(keys, alone), prints.select("node", "keys"), texts)).count()
    assert shared > 4000 and passed < shared / 40
    assert sorted(r.doc_id for r in neardup.deduplicate(table).collect()) == brute(docs)
