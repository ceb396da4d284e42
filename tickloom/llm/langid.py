"""Language identification with error-correcting output codes.

Each language has a binary codeword. For every bit a linear classifier over hashed byte n-grams tells the languages whose bit is 1
from the others. A text's margins are decoded to the codeword of least loss, bits weighted by how reliable their
classifiers proved; a close second marks the answer as ambiguous.

The share of the best language says nothing about texts in none of them, so the text's n-grams have to be likelier in that language than in
an even spread over all buckets, by LEAST_LEAD of what the language's own texts are on average. A text that falls short by over
NONE_MARGIN nats loses score with what it lacks further.

The classifiers are fitted on a bounded sample: at most about `sample_rows` labelled documents, the same number for each
language where there are as many, picked by a hash of the id. Predictions use the text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_texts, chunks, mapped

SAMPLE_ROWS = 16_000
BUCKET_BITS = 16
ORDERS = (2, 3, 4)
#: Languages up to which every distinct split of them gets a bit; more get MAX_BITS splits.
EXHAUSTIVE = 6
MAX_BITS = 48
UNKNOWN = "und"
#: Under this posterior, or with the runner-up within a factor of three, an answer is ambiguous.
LEAST_SCORE = 0.55
#: A text whose best language scores less than this is in none of them.
KEPT_SCORE = 0.4
#: Share of a language's mean evidence for each n-gram that a text in it has to show, and the nats that it may lack in all.
LEAST_LEAD = 0.25
NONE_MARGIN = 5.0
_BLOCK = 1 << 18

#: ASCII letters and all non-ASCII bytes stay; the rest becomes space.
_FOLD = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


def grams(lowered: bytes) -> np.ndarray:
    """Hashed n-grams of lower-cased UTF-8, words set off by single spaces."""
    line = b" " + b" ".join(lowered.translate(_FOLD).split()) + b" "
    b = np.frombuffer(line, np.uint8).astype(np.uint32)
    out, code = [], b
    for n in range(2, max(ORDERS) + 1):
        if len(b) < n:
            break
        code = code[:-1] << np.uint32(8) | b[n - 1 :]
        if n in ORDERS:
            out.append((code * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def codewords(n: int) -> np.ndarray:
    """n x bits, of -1 and 1: all distinct splits of a few languages, or MAX_BITS even splits that a fixed generator draws."""
    if n <= EXHAUSTIVE:
        columns = [[1 if c >> k & 1 else -1 for k in range(n)] for c in range(1, 1 << max(n - 1, 0))]
    else:
        rng, columns = np.random.default_rng(7), []
        # The first bits spell the language's number, so codewords differ whatever the others are.
        for b in range((n - 1).bit_length()):
            columns.append([1 if k >> b & 1 else -1 for k in range(n)])
        while len(columns) < MAX_BITS:
            columns.append(rng.permutation([1] * (n // 2) + [-1] * (n - n // 2)).tolist())
    return np.array(columns, np.int8).reshape(len(columns), n).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # weight of each bit's loss
    lead: np.ndarray | None = None  # languages x buckets: ln of a bucket's share over an even share, less what a text has to show

    def margins(self, codes: np.ndarray) -> np.ndarray:
        """Evidence for each bit; overlapping orders count once."""
        total = np.zeros(self.code.shape[1])
        for a in range(0, len(codes), _BLOCK):
            total += self.weights[codes[a : a + _BLOCK]].sum(0, dtype=np.float64)
        return np.clip(total / len(ORDERS), -60, 60)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = (np.logaddexp(0, -self.code * margins) * self.trust).sum(1)
        like = np.exp(loss.min() - loss)
        share = like / like.sum()
        order = np.argsort(-share, kind="stable")
        best = float(share[order[0]])
        second = float(share[order[1]]) if len(share) > 1 else 0.0
        return self.languages[order[0]], best, best < LEAST_SCORE or 3 * second > best

    def judge(self, codes: np.ndarray) -> tuple[str, float, bool]:
        """The decoded answer, its score reduced where the text is like none of the languages."""
        language, score, doubt = self.decode(self.margins(codes))
        if self.lead is not None:
            evidence = float(self.lead[self.languages.index(language)][codes].sum(dtype=np.float64)) / len(ORDERS)
            score *= float(np.exp(min(0.0, evidence + NONE_MARGIN)))
        return language, score, doubt or score < LEAST_SCORE


def _sample(labelled: DataFrame, sample_rows: int) -> tuple[DataFrame, list[str]]:
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return labelled.where("false"), []
    share = sample_rows / len(languages)
    limits = [(x, int(min(1.0, share / sizes[x]) * (1 << 30))) for x in languages]
    limit = F.create_map(*[F.lit(v) for pair in limits for v in pair])[F.col("lang")]
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) < limit).repartition(8), languages


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits on (doc_id, text, lang). Null langs and texts are left out; rows with null ids share one draw of the sample; repeated rows count as often as they
    occur; an empty table gives a model of no language. Texts are read whole. Runs three jobs over the sample; what reaches the driver is a table of counts
    of fixed size for each language.
    """
    sample, languages = _sample(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), sample_rows)
    code, buckets = codewords(len(languages)), 1 << BUCKET_BITS
    at = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in chunks(batches):
            lowered = pc.utf8_lower(batch.column(1)).cast(pa.binary()).to_pylist()
            for text, lang in zip(lowered, batch.column(2).to_pylist(), strict=True):
                found = np.bincount(grams(text), minlength=buckets)
                sums[lang] = sums.get(lang, 0) + found
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    counts = np.zeros((len(languages), buckets))
    for row in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():
        counts[at[row.lang]] += np.frombuffer(row.counts, "<i8")
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * buckets)
    weights = np.zeros((buckets, code.shape[1]), np.float32)
    for k, bit in enumerate(code.T):
        weights[:, k] = np.log(share[bit == 1].mean(0)) - np.log(share[bit == -1].mean(0))
    lead = np.log(share * buckets)
    lead -= LEAST_LEAD * (share * lead).sum(1, keepdims=True)
    model = Model(languages, code, weights, np.ones(code.shape[1]), lead.astype(np.float32))
    if not code.shape[1]:
        return model
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n, m = np.zeros(code.shape[1], np.int64), 0, shared.value
        for batch in chunks(batches):
            lowered = pc.utf8_lower(batch.column(1)).cast(pa.binary()).to_pylist()
            for text, lang in zip(lowered, batch.column(2).to_pylist(), strict=True):
                right += np.sign(m.margins(grams(text))) == m.code[at[lang]]
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([right.tolist()])], ["n", "good"])

    parts = sample.mapInArrow(verify, "n bigint, good array<bigint>").collect()
    n, right = sum(r.n for r in parts), np.sum([r.good for r in parts], axis=0)
    odds = np.log((right + 1) / (n - right + 1))
    model.trust = np.maximum(odds, 0.05) / np.maximum(odds, 0.05).max() * 4 / max(code.shape[1], 4)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row of docs.

    A null text, or one without a letter, is UNKNOWN with score 0, as is everything if the model knows no language.
    Repeated rows get the same answer, null ids stay null, texts of any length are read whole, an empty table gives no rows; where languages tie the first by
    name is given, as ambiguous. Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, out = shared.value, []
        lowered = pc.utf8_lower(batch.column(1)).cast(pa.binary()).to_pylist()
        for text, low in zip(batch.column(1).to_pylist(), lowered, strict=True):
            out.append(m.judge(grams(low)) if m.languages and has_letter(text) else (UNKNOWN, 0.0, True))
        langs, scores, doubts = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores, pa.float64()), pa.array(doubts)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return mapped(as_texts(docs), chunk, "doc_id bigint, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: Model, least_score: float = KEPT_SCORE) -> DataFrame:
    """docs without the rows whose language is unknown or scores under least_score; all columns stay, nothing is shuffled.

    Null texts go, null ids stay; a repeated row stays as often as it occurs; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, held = docs.columns, [f"_c{i}" for i in range(len(docs.columns))]
    at = names.index("text")

    def chunk(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        lowered = pc.utf8_lower(batch.column(at)).cast(pa.binary()).to_pylist()
        good = [bool(m.languages) and has_letter(text) and m.judge(grams(low))[1] >= least_score for text, low in zip(batch.column(at).to_pylist(), lowered, strict=True)]
        return batch.filter(pa.array(good, pa.bool_()))

    renamed = docs.toDF(*held)
    return mapped(renamed, chunk, renamed.schema, held[at]).toDF(*names)
