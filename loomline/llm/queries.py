"""The queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import chat_events, ctw, decontam, mil_quality, packing, pii, quality_rules, simhash, token_counts, token_files
from loomline.llm.common import scratch, table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.sort_array(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(listed.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is this query's own and begins empty. The first run encodes every distinct text; the second, whose result this is, finds all counts."""
    docs, cache = table(spark, sf_dir, "documents"), scratch(spark, "token-cache")
    token_counts.count_tokens(docs, cache)
    counted = token_counts.count_tokens(docs, cache)
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(spark, token_files.write_files(table(spark, sf_dir, "documents"), scratch(spark, "token-files")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of conversations as one message, and conversation -7."""
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return chat_events.log_of_turns(rows)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "chat")
    chat_events.format_log(conversation_log(spark, sf_dir)).write.parquet(path)
    read = chat_events.parse(spark.read.parquet(path))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.aggregate("learned", F.lit(0).cast("long"), lambda n, t: n + F.length(t)).alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.score(table(spark, sf_dir, "documents")).select(*names)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_token_files, op4_quality, op5_chat, op6_pack, op7_pii, op8_quality_rules, op9_simhash, op10_lm_score)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH items AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
spans AS (SELECT item_id, w, least({decontam.WINDOW}, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM spans, unnest(range(1, len(w) - n + 2)) AS r(i)),
docs AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
places AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM docs, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) AS r(i)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= {decontam.MIN_ITEMS} AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_ESCAPED = "replace(replace(replace({0}, '\\', '\\b'), '#', '\\h'), '<', '\\l')"
_OP5 = rf"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(replace({_ESCAPED.format("role")}, chr(10), '\n')) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM log GROUP BY conv_id
"""


def _rule_sql(rule: quality_rules.Rule) -> str:
    parts = [f"{rule.top}::DOUBLE >= {rule.bottom}::DOUBLE * {rule.low}"] if rule.low is not None else []
    parts += [f"{rule.top}::DOUBLE <= {rule.bottom}::DOUBLE * {rule.high}"] if rule.high is not None else []
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {_BLANKS}, '')) > 0) AS lines,
  regexp_extract_all(lower(t), '{quality_rules.PLAIN}') AS plain FROM d),
places AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM places) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM twice, unnest(range(i, i + 3)) AS r(p) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_BLANKS}, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_exclamations,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words,
  CASE WHEN 2 * (strlen(t) - length(t)) < length(translate(t, {_BLANKS}, '')) THEN len(plain) ELSE 0 END AS n_latin_words, len(list_filter(plain, lambda x: x IN ({_STOPS}))) AS n_stop_words FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_rule_sql, quality_rules.RULES))} AS kept FROM b
"""

ORACLE_SQL = {"op1_decontaminate": _OP1, "op5_chat": _OP5, "op8_quality_rules": _OP8}
