import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import test_decontaminate
import test_neardup
import test_pii
from tokenizers import Tokenizer

from tickloom.llm import packing

ITEM = "what is the name of the river that runs past the old mill"


def corpus():
    rng = random.Random(12)
    en = ["the", "thing", "that", "river", "with", "should", "which", "nothing", "there", "while"]
    fr = ["le", "rivière", "été", "où", "jamais", "aussi", "pour", "voilà", "quelque", "beaucoup"]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(fr if k % 3 == 0 else en, rng.randint(30, 120)), "fr" if k % 3 == 0 else "en") for k in range(60)]
    rows += [(100, None, "en"), (101, "12 34 !", None), (102, "", "en")]
    rows += [(110 + k, rows[k][1], rows[k][2]) for k in range(8)]
    # Near copies: one word of a long text differs.
    rows += [(120 + k, rows[1 + 3 * k][1].rsplit(" ", 1)[0] + " other", "en") for k in range(6)]
    rows += [(130 + k, f"{text(en, 40)} {ITEM.upper()}. {text(en, 30)}", "en") for k in range(3)] + [(140, ITEM, "en")]
    rows += [(150 + k, f"{text(en, 25)} joe{k}@mail.org +1 (988) 555-2485, 10.0.0.{k} and 4111111111111111 {text(en, 20)}", None) for k in range(4)]
    return [(d, t, lang, f"s{d % 4}", len(t) if t is not None else None) for d, t, lang in rows]


def brute(rows, items):
    """Plain versions of the stages, for a corpus whose languages are told apart by eye: rejected documents are those without letters."""
    docs = {d: t for d, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    docs = {d: docs[d] for d in test_neardup.brute(sorted(docs.items()))}
    word = re.compile(test_decontaminate.WORD.pattern)
    item = word.findall(test_decontaminate.lowered(items[0][1]))
    for d, t in list(docs.items()):
        places = list(word.finditer(test_decontaminate.lowered(t)))
        words = [m.group() for m in places]
        hit = {j for i in range(len(words)) for k in range(len(item) - 9) if words[i : i + 10] == item[k : k + 10] for j in range(i, i + 10)}
        if len(hit) > 0.8 * len(words):
            del docs[d]
        elif hit:
            docs[d] = t[: places[min(hit)].start()] + t[places[max(hit)].end() :]
    for d, t in list(docs.items()):
        for kind, pattern in test_pii.PLAIN.items():
            t = re.sub(pattern, lambda m, kind=kind: f"<{kind}>" if test_pii.valid(kind, m.group()) else m.group(), t)
        docs[d] = t
    plain, out = Tokenizer.from_file(packing.default_tokenizer()), Counter()
    for d, t in docs.items():
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        out[d, 0, 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, items = corpus(), [(1, ITEM)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = brute(rows, items)
    assert Counter(tuple(r)[:5] for r in got) == expected
    # Of the near copies some went, and nothing that stands alone did.
    assert 1 <= 6 - sum(120 <= d < 126 for d, *_ in expected) <= 6
    assert len({r.sequence_id for r in got}) <= sum(r.length for r in got) / 2048 + 2


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "pii", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0
