"""One query per operator of this package, over whole tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import (
    chat,
    decontam,
    hmm,
    language,
    merkle,
    mixing,
    neardup,
    pii,
    quality,
    simhash,
    substrings,
    vectordup,
    whitening,
)
from tallybook.llm.common import crc_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = build
        return build

    return register


def _table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


@query("op1_mix_sources")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "source", "text").withColumn("size", mixing.n_words(F.col("text")))
    return mixing.mix(docs.drop("text")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op1_mix_sources"] = r"""
WITH docs AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sources AS (
  SELECT sk, sum(size)::BIGINT AS s, [3, 1, 2][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)::INT] AS w
  FROM docs GROUP BY sk),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(s) OVER ()::BIGINT::DOUBLE
             - coalesce(sum(2 * s) OVER o, 0)::BIGINT::DOUBLE)
            / (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT::DOUBLE AS level,
         row_number() OVER (ORDER BY (2 * s)::DOUBLE / w, sk) AS place
  FROM sources
  WINDOW o AS (ORDER BY (2 * s)::DOUBLE / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT sk, s, least((2 * s)::DOUBLE, (SELECT min_by(level, place) FROM levels WHERE level * w <= 2 * s) * w) AS target
  FROM levels),
placed AS (
  SELECT doc_id, size, s, target, floor(target)::BIGINT AS budget,
         (CASE WHEN s > 0 THEN floor(floor(target) / s) ELSE 0 END)::BIGINT AS epochs,
         (sum(size) OVER (PARTITION BY docs.sk ORDER BY key, doc_id, size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS place
  FROM docs JOIN plan USING (sk))
SELECT doc_id, size, s AS source_size, target,
       epochs * size + greatest(0, least(size, budget - epochs * s - place)) AS taken
FROM placed
"""


@query("op3_chat_format")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    given = _table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = chat.conversations_out(chat.format_segments(given.unionByName(control)))
    turns = chat.read_back(F.col("formatted"))
    listed = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"), "valid")


ORACLE_SQL["op3_chat_format"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS earlier,
    length(text)
    + len(regexp_extract_all(text, '\\|\[/?INST\]|\[/?SYS\]|\[ANS\]|</s>|\[/?ROLE\]|\[TEXT\]'))
    + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9
      ELSE 19 + length(role) + len(regexp_extract_all(role, '\\|\[/?INST\]|\[/?SYS\]|\[ANS\]|</s>|\[/?ROLE\]|\[TEXT\]')) END AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN earlier IS NULL THEN role IN ('system', 'user')
                WHEN earlier = 'system' OR earlier = 'assistant' THEN role = 'user'
                WHEN earlier = 'user' THEN role = 'assistant' ELSE false END)
  AND arg_max(role, n) IN ('user', 'assistant') AS valid
FROM marked GROUP BY conv_id
"""


@query("op2_simhash")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return simhash.with_next(_table(spark, sf, "documents", "doc_id", "text"), pieces)


@query("op6_find_pii")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf, "documents", "doc_id", "text"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [counted(kind) for kind in pii.KINDS]
    base = F.filter("spans", lambda s: s["found"] == "base")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _vocabulary() -> str:
    """Path of the public vocabulary that the query uses; operators take it as an argument."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op8_language_id")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text", "lang")
    held_out = crc_of(F.col("doc_id")) % 5 == 0
    languages, model = language.fit(docs.where(~held_out), _vocabulary())
    found = language.predict(docs.select("doc_id", "text"), _vocabulary(), languages, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op4_hmm_score")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    return hmm.score(docs.withColumn("held_out", crc_of(F.col("doc_id")) % 5 == 1))


@query("op7_near_duplicates")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf, "documents", "doc_id", "text"))


@query("op9_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text", "source", "lang")
    found = quality.classify(docs, _table(spark, sf, "labels", "doc_id", "quality"))
    return found.select("doc_id", "source", F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


@query("op5_decontaminate")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_leaks(_table(spark, sf, "documents", "doc_id", "text"), _table(spark, sf, "benchmark", "item_id", "text"))


@query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


@query("op10_remove_repeats")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "text")
    # Digests are taken before the join, so no text moves for it.
    found = substrings.repeats_by_text(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    return docs.select("doc_id", substrings.text_key(F.col("text")).alias("key")).join(found, "key").drop("key")


@query("op11_whiten_embeddings")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whitened(_table(spark, sf, "embeddings", "vec_id", "embedding"))
    return found.drop("embedding").withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query("op12_near_vectors")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return vectordup.near_duplicates(_table(spark, sf, "embeddings", "vec_id", "embedding"))


@query("op13_merkle_manifest")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents", "doc_id", "source", "lang", "n_chars", "text")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    tampered = F.when(struck, merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), one_more, F.col("text")))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    found = merkle.manifest(docs, tampered).select(
        "doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE_SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, coalesce('/' || lang, '') AS k, n_chars, list_reduce(
      list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ord(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
hashed AS (
  SELECT doc_id, k, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0
      THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS tampered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM hashed),
nodes AS (
  SELECT k, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT k, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY k, level, pos // 2, n),
walk AS (
  SELECT doc_id, k, leaf, coalesce(tampered, leaf) AS h, pos, n, 0 AS level, '' AS sib FROM leaves
  UNION ALL
  SELECT w.doc_id, w.k, w.leaf, sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END),
    w.pos // 2, (w.n + 1) // 2, w.level + 1, w.sib || coalesce(s.h, '')
  FROM walk w LEFT JOIN nodes s ON s.k = w.k AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
tops AS (
  SELECT k, h AS subroot, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper_nodes AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_nodes WHERE n > 1 GROUP BY level, pos // 2, n),
upper_walk AS (
  SELECT w.doc_id, w.leaf, t.subroot, w.h, t.pos, t.n, 0 AS level, w.sib FROM walk w JOIN tops t USING (k) WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END),
    w.pos // 2, (w.n + 1) // 2, w.level + 1, w.sib || coalesce(s.h, '')
  FROM upper_walk w LEFT JOIN upper_nodes s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(sib) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified
FROM upper_walk w, (SELECT h FROM upper_nodes WHERE n = 1) r WHERE w.n = 1
"""
