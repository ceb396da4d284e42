"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: documents with the columns it was given, the last one packed pieces.
Null texts have no language and leave in the first stage; an empty table passes through as one. Rows with null ids are documents like others. Rows that
repeat an id with another text are documents of their own; rows that repeat both are copies, of which the second stage keeps one. Texts of any length are
read whole, and other columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, langid, neardup, packing, pii
from tickloom.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents have. Null and letterless texts go; repeated rows and null ids stay as they are."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id: five-word shingles with a Jaccard similarity of 0.8 or more.

    Null ids come after all others; of repeated rows one stays; texts without words are alike.
    """
    return neardup.deduplicate(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; documents that are little else go. Null texts and ids and repeated rows stay as they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind. No row goes; null texts stay null."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences; a null text is an end alone, a repeated row is packed each time."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("pii", redact_pii),
    ("best_fit_packing", pack),
]

#: SQL can't express these stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. Each stage's documents are written before the next reads them, as stages read their input more than once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
