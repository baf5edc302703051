"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.plans.storage import forget, shared_root, stored  # noqa: F401

#: Broadcast up to so many rows of two longs; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, frames)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for the small frames of iterative algorithms."""
    shared_root(df.sparkSession, checkpoints=True)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, **more) -> DataFrame:
    """Each row of df as one struct, `row`, beside other columns: whatever names
    df's columns have, they clash with nothing.  `row.*` brings them back."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(k) for k, c in more.items()))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it is a stored or small frame of few enough rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
