"""Queries op1 to op13: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as _alignment
from . import decontaminate as _decontaminate
from . import filter_audit as _audit
from . import language_model as _lm
from . import licenses as _licenses
from . import media as _media
from . import packing as _packing
from . import quality as _quality
from . import run_index as _run_index
from . import simhash as _simhash
from . import substring_dedup as _substring
from . import toxicity as _toxicity
from . import warc as _warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _substring.substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.col("_kept_sha256").alias("kept_sha256"),
        F.size("_factors").cast("long").alias("n_factors"),
    )


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _simhash.groups(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_packing.pieces(_table(spark, sf_dir, "documents")))


@_query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op6_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The archives' round trip must give what the pages say.
ORACLE["op6_warc_transactions"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS lo FROM p)
SELECT page_id, size AS payload_bytes, sha256(body) AS payload_digest,
       CASE WHEN size >= 100 AND page_id <> lo THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 100 AND page_id <> lo THEN lo END AS refers_to
FROM f
"""


@_query
def op7_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _media.media_features(_media.encode_media(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    digest = F.concat(F.size("fingerprint").cast("string"), F.lit(":"), F.sha2(F.array_join("fingerprint", ","), 256))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", digest.alias("feature"))


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lm.score(_table(spark, sf_dir, "documents"))


@_query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.license_scan(_table(spark, sf_dir, "documents"), "doc_id", "text", _licenses.document_path())


ORACLE["op10_license_scan"] = _licenses.oracle()


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLE["op11_filter_audit"] = _audit.ORACLE


@_query
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alignment.align(_table(spark, sf_dir, "documents"))


@_query
def op13_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run_index.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")))
