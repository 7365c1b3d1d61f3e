"""One query per operator, over whole tables with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, licenses, line_dedup, minhash, mixing, packing, secrets, toxicity, warc
from .scratch import Scratch

#: Where the public vocabularies are; every executor must see the same path.
TOKENIZERS = os.environ.get("VELLUM_TOKENIZERS", "/opt/tokenizers")
#: 100 * intersection over union from which op1 links documents.
OP1_SIMILARITY = 85
#: Weights in turn, share of all sizes, and most copies of a source.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def mix_propensity(text_col: str = "text") -> Column:
    """Of a source's documents, those of fewer than 400 and of fewer than 100 code points are drawn less often."""
    length = F.coalesce(F.length(text_col), F.lit(0))
    return F.when(length >= 400, 1.0).when(length >= 100, 0.5).otherwise(0.25)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(_table(spark, sf_dir, "documents"), OP1_SIMILARITY)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), scratch.path("warc"), least_bytes=0)
    records = scratch.cut(warc.read_records(spark, scratch.path("warc"), with_payload=False), "records")
    found = warc.resolve_revisits(warc.captures(records))
    refers_to = F.when(F.col("capture.type") == "revisit", F.col("response_page"))
    return found.select(F.col("metadata.page_id").alias("page_id"), F.col("full_bytes").alias("payload_bytes"), F.col("capture.digest").alias("payload_digest"), F.col("capture.type").alias("record_type"), refers_to.alias("refers_to"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_dedup.kept_digests(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_key_points=1))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST, propensity=mix_propensity())
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash": op1_minhash,
        "op2_warc": op2_warc,
        "op3_ann": op3_ann,
        "op4_line_dedup": op4_line_dedup,
        "op5_mixing": op5_mixing,
        "op6_packing": op6_packing,
        "op7_toxicity": op7_toxicity,
        "op8_licenses": op8_licenses,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_secrets": op10_secrets,
    }


_OP4 = r"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), split_rows AS (
  SELECT doc_id, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM parts
), keyed AS (
  SELECT doc_id, pos, line,
    regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line_key
  FROM split_rows
), frequent AS (
  SELECT line_key FROM keyed WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
), flagged AS (
  SELECT k.doc_id, k.pos, k.line, f.line_key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.line_key = f.line_key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

_OP2 = """
WITH hashed AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), coded AS (
  SELECT page_id, payload_bytes::BIGINT AS payload_bytes, hex,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest
  FROM hashed
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id FROM coded
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM first
"""

_OP9 = r"""
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), ranked AS (
  SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, sha256(body) AS text_sha256
  FROM normal WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id)
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": _OP2, "op4_line_dedup": _OP4, "op9_exact_dedup": _OP9}
