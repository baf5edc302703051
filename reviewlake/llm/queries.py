"""The registered queries of this subpackage and, where SQL can express them,
their SQL.  Each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .decontaminate import CONTAINED_SQL, contained
from .html_extract import extract
from .langid import identify
from .media import drawn, image_copies
from .mixing import mix
from .quality import classify
from .secret_scan import SCAN_SQL, digest, secret_scan
from .simhash import hex_print, near_duplicates
from .token_counts import token_counts
from .warc import PAGES_SQL, audit, damaged, page_archive, record_hashes


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mix(docs).select("doc_id", "source", "n_chars", "slot", "offset")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_item", "n_found", F.round(F.col("n_found") / F.col("n_item"), 6).alias("containment"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return digest(secret_scan(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors as a media column, with edited copies of every 50th planted in it."""
    return image_copies(drawn(table(spark, sf_dir, "embeddings")))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_print(F.col("f")).alias("fingerprint"), "component_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as an archive's records, audited against a replica with planted damage."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    a = stored(page_archive(pages, keep=False))
    found = audit(record_hashes(a), record_hashes(page_archive(damaged(pages), keep=False))).withColumnRenamed("file", "_file").withColumnRenamed("offset", "_offset")
    rows = a.select("page_id", "file", "offset", "length", F.col("sha").alias("sha256"))
    return rows.join(found.select("_file", "_offset", "status"), (F.col("file") == F.col("_file")) & (F.col("offset") == F.col("_offset")), "left").select("page_id", "file", "offset", "length", "sha256", F.coalesce("status", F.lit("intact")).alias("status"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_decontaminate, op3_secret_scan, op4_token_counts, op5_media, op6_html_extract, op7_simhash, op8_quality, op9_warc_audit, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": CONTAINED_SQL, "op3_secret_scan": SCAN_SQL, "op9_warc_audit": PAGES_SQL}
