"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm import chat, decontaminate, fuzzy_lines, language, lm_score, main_text, near_dup, pieces, prefix_trie, quality, ranked, shards, substrings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(column: str):
    return F.sha2(F.col(column), 256)


@query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    trick = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trick).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_conversations(rows).withColumns({
        "turns": chat.read_back(F.col("formatted")), "learned": chat.masked_text(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), digest("learned").alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op3_chat_formatting"] = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS x(t)),
e AS (SELECT *, replace(replace(text, '\', '\b'), '<', '\l') AS body FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
       sum(CASE role WHEN 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<turn ' || replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') || '>' || body || '</turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", digest("text").alias("text_sha256"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", digest("kept_text").alias("kept_sha256"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
g AS (SELECT doc_id, pos, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
             || ' ' || lead(word, 4) OVER o AS gram FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR n_symbols > n_words OR 2 * (n_lines - n_dup_lines) < n_lines
            OR 2 * word_chars < 3 * n_words OR word_chars > 25 * n_words) AS kept
FROM m
"""


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(terms) * n_docs) // n_terms AS m FROM d, s),
x AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
o AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 10
"""


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


ORACLES["op13_conversation_prefix_trie"] = r"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(
      list_transform(range(0, length(c::VARCHAR)), lambda i: ascii(substr(c::VARCHAR, (i + 1)::INT, 1))::BIGINT),
      lambda a, b: list_reduce(range(0, 8), lambda x, n: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)),
      4294967295), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM own)),
r AS (
  SELECT c, place, role, text FROM own JOIN k USING (c) WHERE place > h OR c = base
  UNION ALL SELECT k.c, place, role, text FROM k JOIN own ON own.c = k.base WHERE k.c <> k.base AND place <= h),
s AS (
  SELECT c, d, text, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS node
  FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY place) AS d FROM r)
  UNION ALL SELECT c, 0, '', '' FROM k),
e AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS ends FROM s),
n AS (
  SELECT d, node, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS saved, count(*) = count(*) FILTER (ends) AS leaf,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM e GROUP BY d, node),
t AS (
  SELECT s.d, s.node, sum(leaf::BIGINT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM n JOIN s ON s.c = n.conv_id AND s.d <= n.d GROUP BY s.d, s.node),
g AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN t USING (d, node) LEFT JOIN g USING (d, node) LEFT JOIN n p ON p.d = n.d - 1 AND p.node = n.parent
"""
