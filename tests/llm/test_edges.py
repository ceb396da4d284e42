"""Every operator on nulls in any column, empty and very long texts, ties, repeated rows, an empty table and columns with clashing names."""

from collections import Counter

import pytest

from tickloom.llm import chat, decontaminate, langid, lm, neardup, packing, pii, quality, sharding, simhash, substring

LONG = "long word " * 60_000
ROWS = [(None, None), (None, "a few words here"), (1, ""), (1, ""), (2, LONG), (2, "other text of the same id"), (3, None), (4, " \n\t "), (5, "ties tie"), (6, "ties tie"), (6, "ties tie")]
CLASHING = "id fp key node n row word size shard slot spans items score h root gram near sha lang n_chars rank g open base bin".split()


@pytest.fixture(scope="module")
def docs(spark):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *[None if k % 3 else "x" for k in range(len(CLASHING))]) for r in ROWS], f"doc_id long, text string, {extra}")


IDS = Counter(d for d, _ in ROWS)


def ids(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


def test_decontamination(docs, spark):
    items = spark.createDataFrame([(None, "ties tie", 1), (None, None, 2), (1, "", 3), (2, "long word long word", 4)], "item_id long, text string, doc_id long")
    found = decontaminate.find_contamination(docs, items)
    assert ids(found) == IDS
    by = {(r.doc_id, r.n_words): r for r in found.collect()}
    assert by[2, 120_000].spans[0].end == 120_000 and by[2, 120_000].items == ["2"] and by[6, 2].items == [""]
    clean = decontaminate.decontaminate(docs, items)
    assert clean.dtypes == docs.dtypes and ids(clean) == IDS - Counter({2: 1, 5: 1, 6: 2})
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_quality(docs):
    rows = quality.assess(docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS and max(r.n_words for r in rows) == 120_000 and not any(r.kept for r in rows if r.n_words < 50)


def test_substring(docs):
    rows = substring.deduplicate(docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS
    # Of the long text only the first windows stay: each later one starts earlier too.
    assert {(r.n_words, r.n_removed) for r in rows if r.doc_id == 2} == {(120_000, 119_998), (6, 0)}


def test_languages(docs, spark):
    model = langid.fit(docs.drop("lang").withColumnRenamed("id", "lang"))
    assert model.languages == ["x"]
    rows = langid.predict(docs, model).collect()
    assert Counter(r.doc_id for r in rows) == IDS and sum(r.lang_pred == "und" for r in rows) == 5
    assert langid.keep_identified(docs.limit(0), model).count() == 0


def test_scores(docs):
    rows = lm.score(docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS and max(r.n_tokens for r in rows) == 120_001
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in rows) and min(r.bits_per_byte for r in rows if r.n_tokens > 100) < 0.1


def test_simhash(docs):
    rows = simhash.group(docs).collect()
    assert Counter(r.doc_id for r in rows) == IDS
    assert {r.component_id for r in rows if r.fp == 0} == {1} and {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    kept = simhash.deduplicate(docs)
    assert kept.dtypes == docs.dtypes and ids(kept) == Counter({None: 1, 1: 1, 2: 2, 5: 1})


def test_near_duplicates(docs):
    kept = neardup.deduplicate(docs)
    assert kept.dtypes == docs.dtypes and ids(kept) == Counter({None: 1, 1: 1, 2: 2, 5: 1})


def test_shards(docs):
    rows = sharding.kd_shards(docs, 3).collect()
    assert Counter(r.doc_id for r in rows) == IDS and sum(r["size"] for r in rows) == sum(len(t or "") + 1 for _, t in ROWS)
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_pii(docs):
    assert ids(pii.find(docs)) == IDS
    out = pii.redact(docs)
    assert out.dtypes == docs.dtypes and Counter(r.text for r in out.select("text").collect()) == Counter(t for _, t in ROWS)


def test_packing(docs):
    rows = packing.pack_documents(docs).collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == IDS
    long = [r for r in rows if r.doc_id == 2 and r.length == packing.CAPACITY]
    assert len(long) > 50 and sorted(r.start for r in long) == list(range(long[0].start % packing.CAPACITY, max(r.start for r in long) + 1, packing.CAPACITY))


def test_chat(spark):
    turns = [(None, 0, "user", "a"), (1, None, None, None), (1, 0, "assistant", LONG), (1, 0, "assistant", "tie"), (1, 0, "assistant", "tie"), (2, 0, "", "")]
    rows = {r.conv_id: r for r in chat.digest(spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, message int, type string")).collect()}
    assert set(rows) == {None, 1, 2, -7} and rows[1].n_turns == 4 and rows[1].loss_chars == len(LONG) + 6
