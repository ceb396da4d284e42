import random

import numpy as np
import xxhash

from tickloom.llm import simhash as s
from tickloom.llm.components import components


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fps):
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in fps}


def test_golay_code_is_perfect_and_keys_meet():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    code = words ^ s._leaders()[s._remainder(words)]
    assert (s._remainder(code) == 0).all() and (np.bitwise_count(words ^ code) <= 3).all()
    fps = rng.integers(-(2**63), 2**63 - 1, 400)
    for _ in range(3):
        other = fps.copy()
        for _ in range(2):
            other ^= np.int64(1) << rng.integers(0, 63, len(fps))
        va, _, na = s.segment_keys(fps)
        vb, ob, _ = s.segment_keys(other)
        met = np.zeros(len(fps), bool)
        for a in range(3):
            for b in range(3):
                if a != b:
                    met |= (va[a] == vb[a]) & (na[b] == ob[b][:, None]).any(1)
        assert met.all()


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["É", "THE"]
    base = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (1, 2, 3, 4, 60, 200, 400)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "The\tthe THE"), (3, "The\tthe THE")]
    for k in range(4, 90):
        words = rng.choice(base).split()
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((k, (" " if k % 2 else "\n").join(words)))
    got = s.digest(s.group(spark.createDataFrame(docs, "doc_id long, text string"))).collect()
    fps = {d: plain(t) for d, t in docs}
    expected = brute(fps)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{fps[d]:016x}", expected[d]) for d, _ in docs)
    assert len(set(expected.values())) < len(set(fps.values()))
    kept = s.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(expected.values()))


def test_deduplicate_loses_no_component(spark):
    """Ids with several texts, null ids, repeated rows and clashing columns."""
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(4))
    rows = [(5, a), (5, b), (7, b), (7, b), (None, c), (None, c), (9, d), (9, d), (None, None), (11, "")]
    got = s.deduplicate(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int"))
    kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
    # One row of each component, which brute force finds among the distinct texts.
    texts = sorted({t or "" for _, t in rows})
    parts = brute({k: plain(t) for k, t in enumerate(texts)})
    assert kept == sorted([(5, a), (5, b), (0, c), (9, d), (11, "")]) and len(kept) == len(set(parts.values()))
    assert got.columns == ["doc_id", "text", "fp"] and got.where("fp = 1").count() == len(kept)


def test_empty_table(spark):
    assert s.group(spark.createDataFrame([], "doc_id long, text string, fp string")).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 300), (300, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 300: 200}
