"""Registered queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import chat, decontaminate, langid, lm, packing, pii, quality, sharding, simhash, substring
from tickloom.llm.common import crc32_of_id, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.assess(table(spark, sf_dir, "documents")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.deduplicate(table(spark, sf_dir, "documents")))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_of_id(F.col("doc_id")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.group(table(spark, sf_dir, "documents")))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.kd_shards(table(spark, sf_dir, "documents"), n_shards=8))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quality operator measures, without its verdict."""
    return op2_quality_rules(spark, sf_dir).drop("kept", "p_good")


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PII operator's base spans alone."""
    return op9_pii(spark, sf_dir).drop("spans")


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the shards: documents, bytes, whether slots are gapless, and whether bytes are within a hundredth of even."""
    per = op8_kd_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.countDistinct("slot").alias("d"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.max("size").alias("largest"))
    gapless = F.bool_and((F.col("d") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1))
    even = F.max("b") - F.min("b") <= F.greatest(F.sum("b") / 800, F.lit(4) * F.max("largest"))
    return per.agg(F.count("*").alias("shards"), F.sum("n").alias("documents"), F.sum("b").alias("bytes"), gapless.alias("gapless"), even.alias("even"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_rules": op2_quality_rules,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_language_id": op5_language_id,
    "op6_context_tree_scores": op6_context_tree_scores,
    "op7_simhash": op7_simhash,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_pii": op9_pii,
    "op10_best_fit_packing": op10_best_fit_packing,
    # Parts of the above that SQL can express.
    "base_quality": base_quality,
    "base_pii": base_pii,
    "shard_balance": shard_balance,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

def _spans(kind: str, order: int, pattern: str, valid: str) -> str:
    """The valid matches (v) of a pattern with their places."""
    before = "coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0)"
    found = f"SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d"
    placed = f"SELECT doc_id, m[i] AS v, CAST({before} AS BIGINT) AS a FROM ({found}), unnest(generate_series(1, len(m))) AS s(i)"
    return f"SELECT doc_id, '{kind}' AS kind, {order} AS k, a, a + length(v) AS b FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS n FROM ({placed})) WHERE {valid}"


_LUHN = "list_sum(list_transform(generate_series(1, length(n)), lambda i: CASE WHEN i % 2 = 1 THEN CAST(n[-i] AS INTEGER) WHEN CAST(n[-i] AS INTEGER) > 4 THEN 2 * CAST(n[-i] AS INTEGER) - 9 ELSE 2 * CAST(n[-i] AS INTEGER) END)) % 10 = 0"
_BASE = " UNION ALL ".join(
    (
        _spans("email", 1, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _spans("ip", 2, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: coalesce(TRY_CAST(x AS UBIGINT), 999) > 255)) = 0"),
        _spans("card", 3, r"[0-9]([\x20-]?[0-9])+", f"length(n) BETWEEN 16 AND 19 AND {_LUHN}"),
        _spans("phone", 4, r"\+[0-9][\x20().0-9-]+[0-9]", "length(n) BETWEEN 8 AND 15"),
    )
)

#: Only what SQL can express; the other queries are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLDED} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g FROM items, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
grams AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g FROM docs, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op3_substring_dedup": f"""WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, row_number() OVER (PARTITION BY list_slice(w, i, i + 19) ORDER BY doc_id, i) AS k FROM docs, unnest(generate_series(1, len(w) - 19)) AS t(i)),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM windows WHERE k > 1),
words AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(generate_series(1, len(w))) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone.doc_id IS NULL) AS kept, count(gone.doc_id) AS n_removed FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)""",
    "op4_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
l AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '<turn', ''))) // 5 + (length(text) - length(replace(text, '</turn', ''))) // 6 AS body,
 length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '"', '')) + (length(role) - length(replace(role, '<turn', ''))) // 5 + (length(role) - length(replace(role, '</turn', ''))) // 6 AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(12 + head + 2 + body + 8) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id""",
    "base_quality": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 2)) AS c FROM d, unnest(generate_series(1, len(w) - 2)) AS s(i)),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE c > 1) GROUP BY doc_id),
s AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN repeated USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s""",
    "base_pii": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), spans AS ({_BASE}),
counts AS (SELECT doc_id, count(*) FILTER (WHERE k = 1) AS n_email, count(*) FILTER (WHERE k = 2) AS n_ip, count(*) FILTER (WHERE k = 3) AS n_card, count(*) FILTER (WHERE k = 4) AS n_phone, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY k, a) AS listed FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN counts USING (doc_id)""",
    "shard_balance": "SELECT CAST(8 AS BIGINT) AS shards, count(*) AS documents, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes, TRUE AS gapless, TRUE AS even FROM documents",
}
