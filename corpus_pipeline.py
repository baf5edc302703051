"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept
and returns a DataFrame, which is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reviewlake.llm import decontaminate, langid, mixing, secret_scan, simhash
from reviewlake.llm.common import stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the network can tell no language go."""
    return langid.known_language(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least id."""
    return simhash.one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets are redacted in the texts; all documents stay."""
    return secret_scan.redact_live(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place (slot, offset) in the mixture of sources."""
    return mixing.mix(docs)


STAGES = [("language ID", language_id), ("SimHash near-dedup", simhash_dedup), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("mixing sources", mixture)]

#: Language ID and SimHash have no SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
