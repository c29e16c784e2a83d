"""One query for each operator, over whole tables, with production parameters; and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinquery.llm import chat, decontaminate, hmm, packing, quality, secrets, simhash, token_counts, toxicity, warc
from skeinquery.llm.common import fold, shared_path


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links the calls of `conversations`.

    Besides messages that carry calls as JSON, each turn of a dialogue is read as one: a system message calls
    `configure`, a user message calls `reply` in the context of its conversation's turn 0, and the assistant's next turn
    is the result.
    """
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = said.where(F.col("role").isin("system", "user"))
    key = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    system = F.col("role") == "system"
    context = F.when(F.col("turn") > 0, F.lit("$c0")).otherwise(F.lit(""))
    reply = F.to_json(F.struct(F.col("text").alias("prompt"), "turn", context.alias("context")))
    arguments = F.when(system, F.to_json(F.struct(F.col("text").alias("instructions")))).otherwise(reply)
    calls = asked.select("conv_id", key(F.col("turn")).alias("call_id"), "turn", F.lit(0).alias("idx"), F.when(system, "configure").otherwise("reply").alias("name"), arguments.alias("arguments"))
    results = said.where("role = 'assistant'").select("conv_id", key(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    more_calls, more_results = chat.parse(said)
    schemas = spark.sql("""
        SELECT 'reply' AS name, array('prompt', 'turn') AS required, map('prompt', 'string', 'turn', 'integer', 'context', 'string') AS types
        UNION ALL SELECT 'configure', array('instructions'), map('instructions', 'string')""")
    return chat.link_tool_calls(calls.unionByName(more_calls), results.unionByName(more_results), schemas)


OP1_SQL = r"""
WITH said AS (SELECT conv_id, turn, role, text FROM conversations),
calls AS (
  SELECT conv_id, 'c' || turn AS call_id, turn, CASE WHEN role = 'system' THEN 'configure' ELSE 'reply' END AS name,
    CASE WHEN role = 'system' THEN '{"instructions":' || to_json(text)::VARCHAR || '}'
      ELSE '{"context":' || CASE WHEN turn > 0 THEN '"$c0"' ELSE '""' END || ',"prompt":' || to_json(text)::VARCHAR || ',"turn":' || turn || '}' END AS canonical
  FROM said WHERE role IN ('system', 'user')),
results AS (
  SELECT conv_id, 'c' || (turn - 1) AS call_id, count(*) AS n_results, arg_min(text, (turn, text)) AS content
  FROM said WHERE role = 'assistant' GROUP BY ALL)
SELECT c.conv_id, c.call_id,
  CASE WHEN c.name = 'reply' AND c.turn > 0 AND EXISTS (SELECT 1 FROM calls z WHERE z.conv_id = c.conv_id AND z.turn = 0) THEN 1 ELSE 0 END::INTEGER AS level,
  c.turn::BIGINT AS turn, 0::INTEGER AS idx, coalesce(r.n_results, 0)::BIGINT AS n_results, true AS valid, NULL::VARCHAR AS problem,
  '{"arguments":' || c.canonical || ',"id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
FROM calls c LEFT JOIN results r USING (conv_id, call_id)
"""


def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
places AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3),
threes AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places),
repeated AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM threes WHERE n > 1) GROUP BY r),
lines AS (SELECT r, host, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w FROM (SELECT r, host, unnest(string_split(text, chr(10))) AS l FROM docs)),
spoken AS (SELECT r, host, l, len(w) AS size,
  regexp_replace(translate(array_to_string(w, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS normal FROM lines WHERE len(w) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM spoken GROUP BY r),
own AS (SELECT r, host, normal, sum(size) AS size FROM spoken GROUP BY ALL),
frequent AS (SELECT host, normal FROM own GROUP BY ALL HAVING count(*) > 10),
removed AS (SELECT r, sum(size) AS removed FROM own SEMI JOIN frequent USING (host, normal) GROUP BY r),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0)::BIGINT AS removed_words
  FROM docs JOIN words USING (r) LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5e0 * n_words AS kept
FROM base
"""


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", hmm.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the packed pieces: their ids are told by start, length and checksum."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    length = (F.octet_length("ids") / 4).cast("long").alias("length")
    return pieces.select("doc_id", "start", length, F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.piece_scores(vocabulary_path("piece_bpe_32k.model")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS f FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN f IS NULL OR page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f IS NULL OR page_id = f THEN NULL ELSE f END AS refers_to
FROM p LEFT JOIN f USING (d)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, doc_id = table(spark, sf_dir, "documents"), F.col("doc_id")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), fold(doc_id, 5) != 0)
    return scored.select("doc_id", toxicity.held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT r, size, i, array_to_string(w[i : i + size - 1], ' ') AS t
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT r, i, size, item_id FROM places JOIN windows USING (size, t)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat, op2_line_frequency, op3_hmm, op4_packing, op5_token_counts, op6_secrets, op7_simhash, op8_warc, op9_toxicity, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": OP1_SQL, "op2_line_frequency": OP2_SQL, "op8_warc": OP8_SQL, "op10_decontamination": OP10_SQL}
