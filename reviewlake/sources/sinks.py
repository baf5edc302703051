"""Posting of comments, with a status for every row."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Takes (diff_id, comments as dicts); raises if the whole is refused.
Post = Callable[[str, list[dict]], None]
MOST_LOGGED = 50


def dry_run(comments: DataFrame) -> DataFrame:
    """What would be posted: the first 50 comments of each diff."""
    from pyspark.sql import Window

    order = Window.partitionBy("diff_id").orderBy("path", "line", "body")
    return comments.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= MOST_LOGGED).select("diff_id", "path", "line", F.lit("dry-run").alias("status"))


def post(comments: DataFrame, send: Post) -> DataFrame:
    """(diff_id, path, line, status) after sending each diff's comments at once
    and, if that is refused, one by one.  A diff has few comments: findings are
    capped by file and files by diff.  An action runs it; it isn't idempotent, so
    callers write the result once."""

    def each(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        items = rows[["path", "line", "side", "body"]].to_dict("records")
        status = ["ok"] * len(items)
        try:
            send(key[0], items)
        except Exception:
            for i, item in enumerate(items):
                try:
                    send(key[0], [item])
                except Exception as e:
                    status[i] = f"failed: {e}"[:200]
        return rows[["diff_id", "path", "line"]].assign(status=status)

    return comments.groupBy("diff_id").applyInPandas(each, "diff_id string, path string, line int, status string")


def tally(posted: DataFrame) -> DataFrame:
    return posted.groupBy("diff_id").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("failed"))


# Answers of a server that may pass.
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504, 522, 524)


def with_retries(call: Callable[[], object], retryable: tuple[int, ...] = RETRYABLE, attempts: int = 3, base: float = 0.8, cap: float = 12.0, sleep: Callable[[float], None] | None = None, spread: Callable[[], float] = random.random) -> object:
    """The result of call, which raises errors with a `status`; those that may
    pass are tried again after a growing, capped pause, between half and all of
    which is spent by chance (spread gives 0 to 1), so that tasks don't retry together."""
    import time

    for i in range(attempts + 1):
        try:
            return call()
        except Exception as e:
            if i == attempts or getattr(e, "status", None) not in retryable:
                raise
            (sleep or time.sleep)(min(cap, base * 2**i) * (0.5 + spread() / 2))
    raise AssertionError
