import random
import re

import numpy as np

from tickloom.llm import quality as q


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_statistics_match_brute_force(spark):
    rng = random.Random(2)
    parts = ["a", "b", "the", "É#", "日本", "|", "\n", "\n", "  ", "x y", "\x0b", "<p>"]
    texts = [None, "", " \n", "a b", "a a a a a", "x\n\nx\n x"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in q.digest(q.assess(docs)).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_em_finds_the_reliable_rules():
    rng = np.random.default_rng(0)
    good = rng.random(40000) < 0.85
    recall = (0.9, 0.6, 0.5, 0.3, 0.05)
    blamed = np.stack([np.where(good, rng.random(40000) < 0.01, rng.random(40000) < a) for a in recall], 1)
    votes = np.where(rng.random(blamed.shape) < 0.1, 2, ~blamed).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.fit(patterns, counts.astype(float), q.BELIEF)
    assert abs(model.prior - 0.85) < 0.02
    found = model.emission[:, 0, 0] / model.emission[:, 0, :2].sum(1)
    assert (np.diff(found) < 0).all() and np.abs(found - recall).max() < 0.05
    assert ((model.posterior(votes) >= 0.5) == good).mean() > 0.95
    assert q.fit(patterns[:0], counts[:0], q.BELIEF).prior == 0.8


def plain_em(votes, belief):
    """Posterior of each row by expectation-maximisation on the rows themselves, one at a time."""
    n_rules, n = len(votes[0]), len(votes)
    accuracy = [[belief.right_on_bad, belief.right_on_good] for _ in range(n_rules)]
    prior = belief.prior
    for _ in range(500):
        good = []
        for v in votes:
            bad_like, good_like = 1 - prior, prior
            for r, x in enumerate(v):
                if x != 2:
                    bad_like *= accuracy[r][0] if x == 0 else 1 - accuracy[r][0]
                    good_like *= accuracy[r][1] if x == 1 else 1 - accuracy[r][1]
            good.append(good_like / (good_like + bad_like))
        prior = (sum(good) + 2 * belief.prior) / (n + 2)
        last = [list(a) for a in accuracy]
        for r in range(n_rules):
            for c, start in ((0, belief.right_on_bad), (1, belief.right_on_good)):
                weight = [g if c else 1 - g for g in good]
                right = sum(w for w, v in zip(weight, votes) if v[r] == c)
                wrong = sum(w for w, v in zip(weight, votes) if v[r] == 1 - c)
                accuracy[r][c] = (right + start * belief.rows) / (right + wrong + belief.rows)
        if max(abs(a - b) for x, y in zip(accuracy, last) for a, b in zip(x, y)) < 1e-7:
            break
    return good


def test_verdicts_match_brute_force(spark, sf):
    rows = q.assess(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    votes = []
    for r in rows:
        n = max(r.n_words, 1)
        share = lambda x, of=n: x / of if r.n_words else 0.0  # noqa: B023, E731
        pick = lambda bad, good: 0 if bad else 1 if good else 2
        digits = r.n_digits / r.word_chars if r.word_chars else 0.0
        lines = r.n_dup_lines / r.n_lines if r.n_lines else 0.0
        votes.append((
            pick(share(r.n_symbols) > 0.25, share(r.n_symbols) < 0.02), pick(r.n_upper > r.n_lower, r.n_lower > 0 and r.n_upper < 0.15 * r.n_lower), pick(share(r.n_bangs) > 0.25, share(r.n_bangs) < 0.05),
            pick(share(r.n_pipes) > 0.15, r.n_pipes == 0), pick(lines > 0.4, lines < 0.1), pick(share(r.n_repeat_words) > 0.4, share(r.n_repeat_words) < 0.15),
            pick(r.n_words >= 20 and r.n_function < 0.05 * r.n_words, share(r.n_function) > 0.2), pick(r.n_words >= 40 and r.n_ends < 0.005 * r.n_words, 0.01 <= share(r.n_ends) <= 0.3),
            pick(not 2.5 <= share(r.word_chars) <= 14, 3.5 <= share(r.word_chars) <= 9), pick(digits > 0.2, digits < 0.05),
        ))
    good = plain_em(votes, q.BELIEF)
    assert max(abs(r.p_good - g) for r, g in zip(rows, good)) < 1e-4
    assert [r.kept for r in rows] == [not r.base_failed and g >= 0.5 for r, g in zip(rows, good)]


def test_the_posterior_rescues_what_one_rule_blames():
    """A document that only a rule of poor accuracy blames is kept; all-must-pass rules would drop it."""
    rng = np.random.default_rng(1)
    good = rng.random(20000) < 0.8
    blamed = np.stack([np.where(good, rng.random(20000) < 0.2, rng.random(20000) < 0.3), np.where(good, rng.random(20000) < 0.01, rng.random(20000) < 0.9), np.where(good, rng.random(20000) < 0.01, rng.random(20000) < 0.8)], 1)
    patterns, counts = np.unique((~blamed).astype(int), axis=0, return_counts=True)
    model = q.fit(patterns, counts.astype(float), q.BELIEF)
    found = dict(zip(map(tuple, patterns.tolist()), model.posterior(patterns)))
    assert found[0, 1, 1] > 0.9 and found[1, 0, 0] < 0.1


def test_quality_labels_of_the_corpus(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.assess(docs).join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.97 * len(rows)


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5)], "doc_id long, text string, kept int")
    assert q.assess(docs).count() == 2
    assert q.assess(docs.limit(0)).count() == 0
