"""The queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import licenses, lines, media, mixing, neardup, prefix_bpe, quality, secrets, spans, token_counts
from lamina.llm.shared import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir), vocabulary=vocabulary("word_bpe_49k.json"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_common(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.store(documents(spark, sf_dir), ["doc_id"])
    out = media.with_features(media.with_metadata(rows))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth"]
    return out.select(*names)


def op5_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.verdicts(quality.text_counts(documents(spark, sf_dir), ["doc_id", "lang", "source"]))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_decode(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), digests=True)


def op9_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    lengths = token_counts.encoded_lengths(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["lang"])
    return token_counts.full_report(lengths, "lang", LIMITS, SHARES)


#: Context limits that have rows of op10 whether they occur as lengths or not, and its quantiles.
LIMITS, SHARES = [1 << k for k in range(7, 21)], [0.5, 0.9, 0.99]


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Whole documents are split into lines, keys counted once a document.
_LINES = """
WITH l AS (
  SELECT doc_id, coalesce(text, '') AS body, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l
), common AS (
  SELECT line_key FROM (SELECT DISTINCT doc_id, body, line_key FROM k WHERE line_key <> '') GROUP BY line_key HAVING count(*) >= 10
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.line_key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE c.line_key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON k.line_key = c.line_key GROUP BY doc_id, body
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_runs": _LINES}
