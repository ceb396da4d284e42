import hashlib
import random
import re

from tickloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items):
    windows = []
    for item, text in items:
        w = WORD.findall(lowered(text))
        windows += [(item, w[i : i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    out = {}
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add("" if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), len(hit), len(found), sha, bool(hit))
    return out


def sample():
    rng = random.Random(5)
    vocab = ["the", "a", "É", "ab", "Cd", "x1", "日本", "of"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 11, 25])))) for k in range(30)]
    items += [(None, items[5][1]), (7, items[6][1])]
    items += [(100, None), (101, ""), (102, "!!"), (103, items[3][1]), (104, "the")] + [(105, "a b c d e f g h i j")]
    docs = [(0, None), (1, ""), (2, "THE!"), (3, items[4][1] + "-" + items[4][1])]
    docs += [(k, "; ".join(rng.choice(vocab) for _ in range(rng.randint(0, 80))) + " " + items[k % 30][1].upper()) for k in range(4, 60)]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = sample()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block_words in (d.BLOCK_WORDS, 40):
        got = d.digest(d.find_contamination(a, b, block_words=block_words)).collect()
        assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs, items)


def test_empty_tables(spark):
    docs, items = sample()
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.find_contamination(a.limit(0), b).count() == 0
    assert not any(r.contaminated for r in d.digest(d.find_contamination(a, b.limit(0))).collect())


def test_cleaning_cuts_spans_and_keeps_columns(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "Keep this. One, two three four five six seven eight nine TEN! " + "more " * 9, "s"), (2, item, "s"), (3, None, None), (4, "", "t"), (4, "", "t")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] else 7) for r in rows], "doc_id long, text string, row string, n_chars int")
    # One block, and two.
    for items, words in (([(1, item)], d.BLOCK_WORDS), ([(1, item), (2, "six seven eight nine ten eleven twelve thirteen")], 10)):
        got = d.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=words)
        assert got.columns == docs.columns
        kept = "Keep this. ! " + "more " * 9
        assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.doc_id != 3) == [(1, kept, len(kept)), (4, "", 7), (4, "", 7)]
        assert got.where("doc_id = 3 and text is null and n_chars = 7").count() == 1


def test_long_text_and_long_matches(spark):
    """A match of thousands of words crosses many lanes and is one span."""
    rng = random.Random(2)
    item = " ".join(f"w{rng.randrange(50)}" for _ in range(4000))
    text = "x " * 200_000 + item + " y" * 1000 + " " + item
    found = d.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert [tuple(s) for s in found.spans] == [(200_000, 204_000), (205_000, 209_000)] and found.n_words == 209_000
