import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import langid as l
from tickloom.llm.common import crc32_of_id


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 6, 7, 30, 200):
        code = l.codewords(n)
        gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(gaps) >= (2 ** (n - 2) if n <= l.EXHAUSTIVE else 8)
        assert all(len(set(bit)) == 2 for bit in code.T)


def test_wrong_bits_are_corrected():
    m = l.Model(list("abcd"), l.codewords(4), np.zeros((1, 7)), np.ones(7))
    for k in range(4):
        margins = 5.0 * m.code[k]
        margins[k] *= -1
        assert m.decode(margins)[0] == "abcd"[k]
    assert m.decode(np.zeros(7))[2] and not m.decode(9.0 * m.code[0])[2]


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    out = crc32_of_id(F.col("doc_id")) % 3 == 1
    model = l.fit(docs.where(~out), 2000)
    rows = l.predict(docs, model).join(docs.where(out).select("doc_id", "lang", "n_chars"), "doc_id").collect()
    right = [r for r in rows if r.lang == r.lang_pred]
    assert len(right) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_no_letters_and_small_inputs(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "12 ² _ !", "s"), (4, "É", "s"), (4, "É", None)], "doc_id long, text string, score string")
    one = l.fit(spark.createDataFrame([(1, "hello there", "en"), (2, "x", None), (3, None, "fr")], "doc_id long, text string, lang string"))
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in l.predict(docs, one).collect())
    assert got == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (4, "en", 1.0), (4, "en", 1.0)]
    none = l.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in l.predict(docs, none).collect()} == {"und"}
    kept = l.keep_identified(docs, one)
    assert kept.columns == docs.columns and kept.count() == 2
    assert l.predict(docs.limit(0), one).count() == 0


FOREIGN = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "aGVsbG8gd29ybGQgdGhpcyBpcyBhIGxvbmcgc3RyaW5n ZGVmIG1haW4oKToKICAgIHByaW50KCdoZWxsbyB3b3JsZCcp",
]


def test_stage_drops_languages_that_no_label_names(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    foreign = spark.createDataFrame([(-k, t, None) for k, t in enumerate(FOREIGN, 1)], "doc_id long, text string, lang string")
    model = l.fit(docs)
    kept = [r.doc_id for r in l.keep_identified(docs.unionByName(foreign), model).select("doc_id").collect()]
    assert min(kept) >= 0 and len(kept) == docs.count()
    assert all(r.ambiguous and r.score < l.KEPT_SCORE for r in l.predict(foreign, model).collect())
    for gone in ("de", "en"):
        model = l.fit(docs.where(f"lang <> '{gone}'"))
        rows = l.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
        foreign_low = [r.score < l.KEPT_SCORE for r in rows if r.lang == gone]
        other_low = [r.score < l.KEPT_SCORE for r in rows if r.lang != gone]
        assert sum(foreign_low) >= 0.95 * len(foreign_low) and sum(other_low) <= 0.01 * len(other_low)


def plain_grams(text):
    """Hashed n-grams, letter by letter."""
    kept = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in text.lower().encode())
    line = b" " + b" ".join(kept.split()) + b" "
    out = []
    for n in l.ORDERS:
        for i in range(len(line) - n + 1):
            code = int.from_bytes(line[i : i + n], "big")
            out.append(((code * 2654435761 + n * 0x9E3779B9) % (1 << 32)) >> (32 - l.BUCKET_BITS))
    return out


def plain_model(rows):
    """Languages, shares of buckets and weights of bits, by counting."""
    languages = sorted({lang for _, lang in rows})
    counts = {x: Counter(g for t, lang in rows if lang == x for g in plain_grams(t)) for x in languages}
    size = 1 << l.BUCKET_BITS
    share = lambda x, g: (counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * size)
    splits = [[1 if c >> k & 1 else -1 for k in range(len(languages))] for c in range(1, 1 << (len(languages) - 1))]
    mean = lambda names, g: sum(share(x, g) for x in names) / len(names)
    weight = lambda s, g: math.log(mean([x for x, b in zip(languages, s) if b > 0], g)) - math.log(mean([x for x, b in zip(languages, s) if b < 0], g))
    return languages, splits, weight, share


def test_decoding_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = {"a": ["the", "thing", "with", "ship"], "b": ["été", "où", "jamais", "cela"], "c": ["und", "nicht", "über", "doch"], "d": ["está", "niño", "pero", "todo"]}
    rows = [(k, " ".join(rng.choice(vocab[x]) for _ in range(rng.randint(5, 12))), x) for k, x in enumerate("abcd" * 8)]
    model = l.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    languages, splits, weight, share = plain_model([(t, x) for _, t, x in rows])
    assert model.languages == languages and model.code.T.tolist() == splits
    margins = lambda t: [max(-60.0, min(60.0, sum(weight(s, g) for g in plain_grams(t)) / len(l.ORDERS))) for s in splits]
    right = [sum((m > 0) - (m < 0) == s[languages.index(x)] for m, x in zip((margins(t)[k] for _, t, _ in rows), (x for *_, x in rows))) for k, s in enumerate(splits)]
    odds = [max(math.log((r + 1) / (len(rows) - r + 1)), 0.05) for r in right]
    trust = [o / max(odds) * 4 / max(len(splits), 4) for o in odds]
    size = 1 << l.BUCKET_BITS
    floor = {x: l.LEAST_LEAD * sum(share(x, g) * math.log(share(x, g) * size) for g in range(size)) for x in languages}
    mixed = [(k, " ".join(rng.choice(vocab[rng.choice(pair)]) for _ in range(6))) for k, pair in enumerate(["ab", "ac", "dd", "bb", "cd", "bc"] * 3)] + [(99, "zzz qqq xxx"), (100, "1 2")]
    for r in l.predict(spark.createDataFrame(mixed, "doc_id long, text string"), model).collect():
        text = dict(mixed)[r.doc_id]
        if text == "1 2":
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        loss = [sum(w * math.log1p(math.exp(-s[i] * m)) for s, m, w in zip(splits, margins(text), trust)) for i in range(len(languages))]
        best = min(range(len(languages)), key=lambda i: loss[i])
        score = 1 / sum(math.exp(loss[best] - x) for x in loss)
        lead = sum(math.log(share(languages[best], g) * size) - floor[languages[best]] for g in plain_grams(text)) / len(l.ORDERS)
        assert r.lang_pred == languages[best] and abs(r.score - score * math.exp(min(0.0, lead + l.NONE_MARGIN))) < 1e-3


def test_nulls_ties_repeats_and_clashing_columns(spark):
    """Rows that repeat stay as often as they occur; a tie between languages is ambiguous; other columns may have any names."""
    rows = [(None, "la la la", "x"), (2, "la la la", "y"), (3, "la", None)]
    model = l.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(7, "la la", 1, 2), (7, "la la", 1, 2), (None, None, 3, 4), (8, "la " * 50_000, 5, 6)], "doc_id long, text string, score int, ambiguous int")
    got = l.predict(docs, model).collect()
    assert len(got) == 4 and all(r.ambiguous for r in got)
    kept = l.keep_identified(docs, model, 0.1)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.score) for r in kept.collect()) == [(7, 1), (7, 1), (8, 5)]
