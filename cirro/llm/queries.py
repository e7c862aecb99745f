"""The queries opN_<name> of this package: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cirro.llm import chat, decontam, langid, linededup, packing, quality, rollup, sharding, simhash, toxicity
from cirro.llm.common import learn_part, materialize, shared_path, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.train(docs, langid.load_pieces(tokenizer_file("piece_bpe_32k.model")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", F.coalesce(learn_part(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(learn_part(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", *quality.BASE, "base_failed", "kept", "anomaly")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_chat(chat.as_tool_messages(table(spark, sf_dir, "conversations")), chat.REPLY)
    return out.withColumn("errors", F.array_join("errors", ","))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those whose id ends in 7 are revised, their text being trimmed and doubled and counted under a new version; those whose id ends in 3 are deleted. Batches are replayed and compacted between."""
    docs, path = table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")
    totals = rollup.Rollup(spark, shared_path(spark, "token-rollup"))
    counts = materialize(rollup.token_counts(docs, path, "1"), "token-counts")
    digit = F.pmod(F.col("doc_id"), F.lit(10))
    text = F.btrim("text")
    new = rollup.token_counts(docs.where(digit == 7).withColumn("text", F.concat(text, F.lit(" "), text)), path, "2")
    totals.commit("all documents", rollup.inserts(counts))
    totals.commit("all documents", rollup.inserts(counts))  # a replay, which counts for nothing and runs nothing
    totals.commit("revised", rollup.revisions(counts.where(digit == 7), new))
    totals.compact()
    totals.commit("deleted", rollup.deletes(counts.where(digit == 3)))
    totals.commit("revised", rollup.revisions(counts.where(digit == 7), new))
    return totals.totals()


QUERIES = {"op1_packing": op1_packing, "op2_chat": op2_chat, "op3_simhash": op3_simhash, "op4_sharding": op4_sharding, "op5_toxicity": op5_toxicity, "op6_decontamination": op6_decontamination, "op7_line_dedup": op7_line_dedup, "op8_quality": op8_quality, "op9_token_counts": op9_token_counts, "op10_language_id": op10_language_id}

#: Whitespace is U+0020 and U+0009 to U+000D; the lower-casing is of A-Z alone.
ORACLE_SQL: dict[str, str] = {
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, i - 1 AS pos, ls[i] AS line,
         translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM lines WHERE length(key) >= 10 GROUP BY key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id > first_doc) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (first_doc IS NULL OR doc_id = first_doc), '')) AS kept_sha256
FROM lines LEFT JOIN firsts USING (key) GROUP BY doc_id
""",
    "op2_chat": r"""
WITH base AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN 0 ELSE conv_id % 5 END AS kind,
         CAST(to_json(text) AS varchar) AS quoted,
         '"chars":' || coalesce(CAST(length(text) AS varchar), 'null') || ',"prompt":' || coalesce(CAST(to_json(text) AS varchar), 'null') AS inside,
         '{"prompt":' || coalesce(CAST(to_json(text) AS varchar), 'null') || ',"chars":' || coalesce(CAST(length(text) AS varchar), 'null') AS cut
  FROM conversations
), calls AS (
  SELECT conv_id, turn, any_value(kind) AS kind, 'c' || conv_id || '-' || turn AS call_id, count(*) AS n_calls, bool_or(text IS NULL) AS broken,
         min_by(inside, cut) AS inside, min(cut) AS cut
  FROM base WHERE role = 'user' GROUP BY conv_id, turn
), runs AS (
  SELECT conv_id, turn, count(*) OVER r AS n, max(turn) OVER r AS last
  FROM (SELECT conv_id, turn, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run, turn % 2 AS side FROM calls)
  WINDOW r AS (PARTITION BY conv_id, side, run)
), odd AS (
  SELECT conv_id, max(n) > 1 AS odd FROM runs GROUP BY conv_id
), placed AS (
  SELECT calls.*, CASE WHEN odd AND kind = 1 THEN (last - turn) // 2 WHEN odd AND kind = 2 THEN CASE WHEN n > 1 THEN NULL ELSE 0 END ELSE turn END AS topo
  FROM calls JOIN runs USING (conv_id, turn) JOIN odd USING (conv_id)
), results AS (
  SELECT conv_id, 'c' || conv_id || '-' || (turn - 1) AS call_id, min(CASE WHEN kind = 4 THEN turn - 2 ELSE turn END) AS result_turn, min(text) AS content, count(*) AS n_results
  FROM base WHERE role = 'assistant' GROUP BY conv_id, turn
), linked AS (
  SELECT conv_id, call_id, turn, result_turn, kind, inside, cut, content, broken, topo, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
         CASE WHEN n_calls IS NULL THEN 'no_call' WHEN n_results IS NULL THEN 'no_result' WHEN kind = 4 THEN 'early_result' ELSE 'linked' END AS status,
         n_calls IS NOT NULL AS called
  FROM placed FULL JOIN results USING (conv_id, call_id)
), told AS (
  SELECT *, CASE WHEN NOT called OR kind = 3 THEN 'null' WHEN kind = 4 THEN '{' || inside || ',"rate":1,"seed":1.2345678901234567E49}' ELSE '{' || inside || '}' END AS arguments,
         CASE WHEN NOT called OR kind NOT IN (3, 4) THEN '' ELSE ',"raw_arguments":' || CAST(to_json(CASE WHEN kind = 3 THEN cut ELSE cut || ',"seed":12345678901234567890123456789012345678901234567890,"rate":1.0}' END) AS varchar) END AS raw,
         CASE WHEN NOT called THEN '' WHEN kind = 3 THEN 'json' ELSE concat_ws(',', CASE WHEN broken THEN 'type:chars' END, CASE WHEN broken THEN 'type:prompt' END, CASE WHEN kind = 4 THEN 'type:seed' END) END AS errors
  FROM linked
)
SELECT conv_id, call_id, turn, result_turn, status, topo, n_calls, n_results, errors,
       '{"arguments":' || arguments || ',"call_id":"' || call_id || '","conv_id":' || conv_id || ',"name":' || CASE WHEN called THEN '"reply"' ELSE 'null' END || raw
       || ',"result":' || coalesce(CAST(to_json(content) AS varchar), 'null') || ',"status":"' || status || '","turn":' || coalesce(CAST(turn AS varchar), 'null') || '}' AS json
FROM told
UNION ALL
SELECT conv_id, NULL, turn, NULL, 'message', turn, 0, 0, '',
       '{"content":' || coalesce(quoted, 'null') || ',"conv_id":' || coalesce(CAST(conv_id AS varchar), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS varchar), 'null') || ',"turn":' || coalesce(CAST(turn AS varchar), 'null') || '}'
FROM base WHERE role IS NULL OR role NOT IN ('user', 'assistant')
""",
}
