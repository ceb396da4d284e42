import random
import zlib

import numpy as np
import pyarrow as pa

from tickloom.llm import packing as p


def test_cached_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(p.default_tokenizer())
    rng = random.Random(1)
    parts = ["the", "it's", "É", "日本", " ", " ", " ", "\n", "\t", "  ", "12", "a1!", " ", " ", "<|endoftext|>", "'ll", "\x1c", "\r\n"]
    texts = ["", " ", "a ", " a", "a  b", "a   b", "a \n b", "\t \t b"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in p.Encoder(p.default_tokenizer()).encode(pa.array(texts))]
    expected = [x.ids for x in plain.encode_batch(texts, add_special_tokens=False)]
    assert got == expected
    # A slice of a batch, as chunks are, and a cache that turns over.
    encoder = p.Encoder(p.default_tokenizer())
    before, p.CACHE_ENTRIES = p.CACHE_ENTRIES, 20
    try:
        for a in range(0, 600, 50):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(pa.array(texts).slice(a, 50))] == expected[a : a + 50]
    finally:
        p.CACHE_ENTRIES = before


def test_pieces(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(p.default_tokenizer())
    docs = [(1, None), (2, ""), (3, "the of and " * 40), (4, "x"), (4, "x"), (5, "the" + " the" * 62)]
    got = p.pieces(spark.createDataFrame(docs, "doc_id long, text string"), capacity=32).collect()
    expected = []
    for d, t in docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 32 or 32
        cuts = [0, *range(first, len(ids) + 1, 32)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(tuple, got)) == sorted(expected)


def optimum(lengths, capacity):
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                bins[i] += lengths[k]
                place(k + 1, bins)
                bins[i] -= lengths[k]
        bins.append(lengths[k])
        place(k + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_bound_never_exceeds_the_optimum():
    rng = random.Random(4)
    tight = 0
    for _ in range(150):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 8))), reverse=True)
        best, bound = optimum(lengths, 20), p.lower_bound(np.array(lengths), 20)
        assert bound <= best <= max(p.best_fit(lengths, 20)[0]) + 1
        tight += bound == best
    assert tight > 120


def test_pack_is_gapless_whole_and_near_the_bound(spark):
    rng = random.Random(9)
    rows = [(i, 0, 0, min(100, max(1, int(rng.lognormvariate(3, 1)))), i) for i in range(6000)] + [(7, 0, 0, 50, 7)] * 3
    items = spark.createDataFrame(rows, p.PIECES)
    out = p.pack(items, capacity=100, group_rows=150).toPandas()
    assert sorted(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == sorted(rows)
    for _, x in out.sort_values("offset").groupby("sequence_id"):
        assert x["offset"].tolist() == [0, *x["length"].cumsum().tolist()[:-1]] and x["length"].sum() <= 100
    bound = p.lower_bound(np.array([r[3] for r in rows]), 100)
    assert out["sequence_id"].nunique() <= bound + 2
    assert p.pack(items.limit(0)).count() == 0


def test_groups_stay_bounded_where_every_group_has_a_gap(spark, monkeypatch):
    """Lengths of a third of the capacity and more leave large gaps; groups of later rounds are no larger for it, and every row stays."""
    rng = random.Random(2)
    rows = [(i, 0, 0, rng.randint(410, 700), i) for i in range(12_000)]
    inner = p.pack_group

    class Most:
        def zero(self, v):
            return 0

        def addInPlace(self, a, b):
            return max(a, b)

    sizes = spark.sparkContext.accumulator(0, Most())

    def spied(x, capacity):
        sizes.add(len(x))
        return inner(x, capacity)

    def settler(capacity, level):
        def settle(x):
            g = int(x["g"].iloc[0])
            out = spied(x, capacity)
            out["sequence_id"] = (level << 56) + (g << 24) + out["bin"]
            return out[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "g", "open"]]

        return settle

    monkeypatch.setattr(p, "_settler", settler)
    out = p.pack(spark.createDataFrame(rows, p.PIECES), group_rows=1000).toPandas()
    assert sorted(out["doc_id"]) == list(range(12_000)) and sizes.value < 1300
    assert out.groupby("sequence_id")["length"].sum().max() <= 2048


def test_null_ids_and_repeated_rows_are_packed_as_often_as_they_occur(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    out = p.pack_documents(docs).collect()
    assert sorted((r.doc_id is None, r.length) for r in out) == [(False, 1), (False, 1), (True, 3), (True, 3)]
