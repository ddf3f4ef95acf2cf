"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_kept", "removed")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import edited_report

    return edited_report(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    docs = read(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return shard(docs, 16).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    out = quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_report

    text = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-1 AS BIGINT) conv_id, CAST(k AS BIGINT) turn, IF(k = 0, 'user', 'assistant') role, '{text}' text FROM VALUES (0), (1) AS t(k)")
    return chat_report(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(read(spark, sf_dir, "documents")).drop("digest")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    out = scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_fingerprints, op3_sharding, op4_mixing, op5_quality, op6_chat, op7_language_id, op8_packing, op9_jaccard_join, op10_licenses)}

#: The draw is an MD5, so DuckDB can follow it; sums and thresholds as in ``mixing``.
MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS ratio, coalesce(sum(cap) OVER b, 0) AS full_cap, coalesce(sum(weight) OVER b, 0) AS full_weight, sum(source_size) OVER () * 1.5::DOUBLE AS goal, sum(weight) OVER () AS all_weight
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (goal - full_cap) / (all_weight - full_weight) AS level FROM o),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE ratio >= level),
t AS (SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, weight * f.level) END AS target FROM l, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
k AS (SELECT *, floor(rate + 1e-9) AS whole, greatest(0.0, rate - floor(rate + 1e-9)) AS fraction FROM r),
c AS (SELECT source, cell, sum(size) OVER (PARTITION BY source ORDER BY cell) AS below FROM (SELECT source, u >> 36 AS cell, sum(size) AS size FROM d GROUP BY ALL)),
m AS (SELECT c.source, cell, abs(below - fraction * source_size) AS miss, fraction * source_size AS need FROM c JOIN k ON c.source IS NOT DISTINCT FROM k.source),
b AS (SELECT source, CASE WHEN max(need) <= min(miss) THEN 0 ELSE arg_min(cell, (miss, cell)) + 1 END AS edge FROM m GROUP BY source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN u < edge * (1::BIGINT << 36) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""

CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '[INST]', ''))) // 6
  + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS controls, length(text) - length(replace(text, '\', '')) AS slashes FROM c),
p AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, length(role) + length(text) + 8 + CASE WHEN role = 'user' THEN 15 ELSE 0 END + CASE WHEN controls > 0 THEN 1 + controls + slashes ELSE 0 END AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id, alone
"""

ORACLES = {"op4_mixing": MIXING_SQL, "op6_chat": CHAT_SQL}
