"""Document quality by weak supervision.

Cheap text statistics feed rules that vote good or bad or abstain. Rows are reduced to counts of vote patterns (at most
3 ** rules of them, whatever the corpus), on which expectation-maximisation estimates each rule's accuracy without labels. A
document is kept when the posterior probability of being good, given its pattern, reaches a threshold; no single rule decides.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_texts, byte_texts, cut, mapped
from tickloom.llm.labelmodel import Belief, fit

_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>"

#: Function words of English, French, German and Spanish. Fixed values.
FUNCTION_WORDS = frozenset(
    b"the of and to in is that it for on with as was be by are this from a an or at de la le les et un une des du en est que qui dans pour par sur avec au ou pas der die das und ist nicht ein eine von mit den dem zu im auf als auch sich el los las y del por con para se una su al lo es".split()
)

_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs", "n_pipes", "n_digits", "n_function", "n_ends", "n_distinct")


def statistics(text: bytes | None) -> tuple[int, ...]:
    """The values of _STATS for a text; all zero for null."""
    text = text or b""
    words = text.split()
    count = lambda kind: len(text) - len(text.translate(None, kind))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    repeated, number = 0, {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(words) > 3:
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) ** 3 >= 1 << 62:
            pair = np.unique(pair, return_inverse=True)[1]
        key = pair[:-1] * len(number) + ids[2:]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key) + 2, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        covered = twice.copy()
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        repeated = int(covered.sum())
    function = sum(w in FUNCTION_WORDS for w in map(bytes.lower, words))
    ends = sum(w[-1] in b".!?:;" and not w.endswith(b"!!") for w in words)
    return (
        len(words), len(text.translate(None, _SPACE + _CONTINUATION)), count(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines),
        count(_UPPER), count(_LOWER), count(b"!"), count(b"|"), count(b"0123456789"), function, ends, len(number),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and _STATS (bigint) for each row of docs."""

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([statistics(x) for x in byte_texts(batch)], np.int64).reshape(-1, len(_STATS))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(v)) for v in values.T)], ["doc_id", *_STATS])

    return mapped(as_texts(docs), chunk, "doc_id bigint, " + ", ".join(f"{x} bigint" for x in _STATS))


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) or 0 (bad); null if neither condition holds."""

    name: str
    bad: Callable[[], Column]
    good: Callable[[], Column]

    def vote(self) -> Column:
        return F.when(self.bad(), 0).when(self.good(), 1).cast("tinyint").alias(self.name)


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


#: Rules judge shape, not topic or tone. Each has a dead zone in which it abstains.
RULES = (
    Rule("symbols", lambda: _share("n_symbols", "n_words") > 0.25, lambda: _share("n_symbols", "n_words") < 0.02),
    Rule("shouting", lambda: F.expr("n_upper > n_lower"), lambda: F.expr("n_lower > 0 and n_upper < 0.15 * n_lower")),
    Rule("exclamations", lambda: _share("n_bangs", "n_words") > 0.25, lambda: _share("n_bangs", "n_words") < 0.05),
    Rule("table", lambda: _share("n_pipes", "n_words") > 0.15, lambda: F.col("n_pipes") == 0),
    Rule("repeated_lines", lambda: _share("n_dup_lines", "n_lines") > 0.4, lambda: _share("n_dup_lines", "n_lines") < 0.1),
    Rule("repeated_words", lambda: _share("n_repeat_words", "n_words") > 0.4, lambda: _share("n_repeat_words", "n_words") < 0.15),
    Rule("function_words", lambda: F.expr("n_words >= 20 and n_function < 0.05 * n_words"), lambda: _share("n_function", "n_words") > 0.2),
    Rule("sentence_ends", lambda: F.expr("n_words >= 40 and n_ends < 0.005 * n_words"), lambda: _share("n_ends", "n_words").between(0.01, 0.3)),
    Rule("word_length", lambda: ~_share("word_chars", "n_words").between(2.5, 14.0), lambda: _share("word_chars", "n_words").between(3.5, 9.0)),
    Rule("digits", lambda: _share("n_digits", "word_chars") > 0.2, lambda: _share("n_digits", "word_chars") < 0.05),
)


#: A rule rarely blames a good document and finds two of five bad ones.
BELIEF = Belief(prior=0.8, right_on_good=0.97, right_on_bad=0.4)


def assess(docs: DataFrame, threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, _STATS, base_failed, p_good and kept for each row of docs.

    Rules are fitted on all rows. Null, empty and blank texts have no words and fail the base; texts of any length are read whole. Repeated rows and null
    ids count and are returned as often as they occur; an empty table gives none; other columns are not read. Runs a job: the statistics are written once, patterns counted.
    """
    stats = cut(measure(docs))
    voted = stats.select("*", *[rule.vote() for rule in rules])
    names = [rule.name for rule in rules]
    pattern = F.concat(*[F.coalesce(F.col(x).cast("string"), F.lit("2")) for x in names])
    keyed = voted.withColumn("pattern", pattern).drop(*names)
    seen = [(r["pattern"], r["n"]) for r in keyed.groupBy("pattern").agg(F.count("*").alias("n")).collect()]
    votes = np.array([list(map(int, p)) for p, _ in seen], np.int64).reshape(-1, len(rules))
    model = fit(votes, np.array([n for _, n in seen], np.float64), BELIEF)
    scored = [(p, float(x)) for (p, _), x in zip(seen, model.posterior(votes), strict=True)]
    verdicts = docs.sparkSession.createDataFrame(scored, "pattern string, p_good double")
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    out = keyed.join(F.broadcast(verdicts), "pattern").drop("pattern").withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def digest(assessed: DataFrame) -> DataFrame:
    return assessed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
