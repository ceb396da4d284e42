import math
import random
import zlib
from collections import Counter, defaultdict

from tickloom.llm import sharding as s


def test_balanced_whole_and_gapless(spark):
    rng = random.Random(6)
    texts = ["x" * int(rng.lognormvariate(4, 1)) + str(k) for k in range(900)]
    rows = [(k, t, rng.choice(["en", "fr", None]), len(t) if k % 7 else None, "s") for k, t in enumerate(texts)]
    rows += [(10_000 + k, "copy " * 20, "en", 100, "s") for k in range(500)] + [(20_000, None, "en", None, "s"), (20_001, "", None, 0, "s"), (3, texts[3], rows[3][2], rows[3][3], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, shard string")
    for n in (8, 5, 1):
        got = s.digest(s.kd_shards(docs, n)).collect()
        sizes = {len((t or "").encode()) + 1 for _, t, *_ in rows}
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
        loads, slots = Counter(), defaultdict(list)
        for r in got:
            loads[r.shard] += r["size"]
            slots[r.shard].append(r.slot)
        assert sorted(loads) == list(range(n)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert max(loads.values()) - min(loads.values()) <= 4 * max(sizes)


def test_small_groups_stay_together(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(50, 90))) for _ in range(1400)]
    docs = spark.createDataFrame([(k, texts[k // 3], "en", 1) for k in range(4200)], "doc_id long, text string, lang string, n_chars long")
    homes = defaultdict(set)
    for r in s.kd_shards(docs, 8).collect():
        homes[texts[r.doc_id // 3]].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())


def test_target_bytes_and_empty(spark):
    docs = spark.createDataFrame([(k, "y" * 99) for k in range(64)], "doc_id long, text string")
    assert s.kd_shards(docs, target_bytes=1600).select("shard").distinct().count() == 4
    assert s.kd_shards(docs.limit(0), 8).count() == 0
    assert s.kd_shards(docs.limit(2), 8).count() == 2


def plain_cut(rows, target):
    """(key, sum before, sum at) of the least key up to which the sizes of (key, size) reach the target."""
    sums, before = Counter(), 0
    for key, size in rows:
        sums[key] += size
    for key in sorted(sums):
        if before + sums[key] >= target:
            return key, before, sums[key]
        before += sums[key]


def plain_tree(rows, first, leaves, tolerance, out):
    """Shards of (place, size, tie, keys) by recursion on sorted lists."""
    if leaves == 1 or not rows:
        out.update({r[0]: first for r in rows})
        return
    spans = [max(r[3][i] for r in rows) - min(r[3][i] for r in rows) for i in range(len(rows[0][3]))]
    dim, total, half = spans.index(max(spans)), sum(r[1] for r in rows), leaves // 2
    target = math.ceil(total * half / leaves)
    at, before, here = plain_cut([(r[3][dim], r[1]) for r in rows], target)
    if here <= tolerance * total / leaves:
        tie = 1 << 31 if 2 * (target - before) >= here else -1
    else:
        t, b, h = plain_cut([(r[2], r[1]) for r in rows if r[3][dim] == at], target - before)
        tie = t if 2 * (target - before - b) >= h else t - 1
    left = [r for r in rows if (r[3][dim], r[2]) <= (at, tie)]
    plain_tree(left, first, half, tolerance, out)
    plain_tree([r for r in rows if (r[3][dim], r[2]) > (at, tie)], first + half, leaves - half, tolerance, out)


def test_shards_match_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(k, "w" * int(rng.lognormvariate(3, 1)) + str(k), rng.choice(["en", "fr", "de", None]), rng.randint(0, 500)) for k in range(600)]
    rows += [(1000 + k, "copy " * 30, rng.choice(["en", "fr"]), 150) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    points = {r.doc_id: r for r in s._points(docs, s.DIMENSIONS).collect()}
    assert len({(r.k0, r.k1) for d, r in points.items() if d >= 1000}) == 1
    for n, most in ((8, s.BROADCAST_ROWS), (5, 0)):
        monkeypatch.setattr(s, "BROADCAST_ROWS", most)
        expected = {}
        plain_tree([(d, r["size"], r.tie, (r.k0, r.k1)) for d, r in points.items()], 0, n, s.TOLERANCE, expected)
        assert {r.doc_id: r.shard for r in s.kd_shards(docs, n).collect()} == expected


def test_equal_texts_stay_together_whatever_their_metadata(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(50, 90))) for _ in range(1400)]
    docs = spark.createDataFrame([(k, texts[k // 3], rng.choice(["en", "fr", None]), rng.randint(1, 99)) for k in range(4200)], "doc_id long, text string, lang string, n_chars long")
    homes = defaultdict(set)
    for r in s.kd_shards(docs, 8).collect():
        homes[texts[r.doc_id // 3]].add(r.shard)
    assert all(len(x) == 1 for x in homes.values())
