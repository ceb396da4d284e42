import random

import numpy as np

from tickloom.llm import neardup, simhash


def texts(rng, n=200, changed=4):
    words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
    other = list(words)
    for at in rng.sample(range(5, n - 1), changed):
        other[at] = "x"
    return [neardup.shingles(" ".join(x).encode()) for x in (words, other)]


def test_buckets_of_the_stage_are_codewords_near_simhash_segments(spark):
    """The stage's keys are those of SimHash segments: all Golay codewords within four bits, by trying each of the 4096."""
    codewords = np.array([next(c for c in [i << 11] for c in [c ^ int(simhash._remainder(np.array([c]))[0])]) for i in range(4096)])
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(900)}" for _ in range(120))
    found = neardup.shingles(text.encode())
    ones = np.zeros(256, int)
    for h in found:
        ones += np.concatenate([np.unpackbits(neardup._mix(np.array([h ^ s])).view(np.uint8)) for s in neardup._SALTS[:4]])
    bits = 2 * ones > len(found)
    expected = set()
    for k in range(neardup.SEGMENTS):
        word = int(bits[23 * k : 23 * k + 23] @ (1 << np.arange(23)))
        expected |= {k << 12 | int(c) >> 11 for c in codewords if int(c ^ word).bit_count() <= 4}
    row = neardup._prints(neardup._keyed(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert set(row["keys"]) == expected and len(row["keys"]) == len(expected)


def test_similar_texts_share_a_bucket_and_are_near():
    rng = random.Random(7)
    for n, changed in [(200, 4), (200, 2), (60, 1), (900, 18)] * 60:
        a, b = texts(rng, n, changed)
        if neardup.similar(a, b):
            x, y = neardup.fingerprint(a), neardup.fingerprint(b)
            assert set(neardup.golay_keys(x)) & set(neardup.golay_keys(y))
            assert (x[:256] != y[:256]).sum() <= neardup.MOST_BITS_APART


def test_leaders_and_straddlers_leave_no_near_node_out(monkeypatch):
    monkeypatch.setattr(neardup, "_CELLS", 500)  # several blocks
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, (4, 6), np.uint64)
    bits = base[:, rng.integers(0, 6, 120)] ^ (np.uint64(1) << rng.integers(0, 63, (4, 120), np.uint64))
    bits = np.concatenate((bits, rng.integers(0, 1 << 63, (4, 60), np.uint64)), axis=1)
    most, part = np.full(180, 68, np.int32), rng.integers(0, 3, 180)
    near = sum(np.bitwise_count(w[:, None] ^ w).astype(int) for w in bits) <= 68
    np.fill_diagonal(near, False)
    a, b = neardup.led(bits, most)
    assert near[a, b].all() and set(a) | set(b) == set(np.flatnonzero(near.any(1))) and len(a) < 180
    got = neardup.straddling(bits, most, np.zeros((8, 180), np.uint64), part)
    assert (got == (near & (part[:, None] != part)).any(1)).all()
