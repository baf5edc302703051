"""Diffs as they come: an extension for streams of the batch plan.

Parsing and single-line rules keep no state, so they run on the stream itself;
what needs a whole diff (frames, merging, caps) runs on each micro-batch, in
which a diff is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reviewlake.plans.review import Settings, review
from reviewlake.sources.diffs import DIFFS


def diff_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """diffs from Parquet files that arrive below path."""
    return spark.readStream.schema(DIFFS).option("maxFilesPerTrigger", per_trigger).parquet(path)


def review_stream(diffs: DataFrame, out: str, checkpoint: str, settings: Settings = Settings(), **options) -> StreamingQuery:
    """Reviews each micro-batch into out/findings and out/errors.  A batch that
    is run again writes the same folder again, so findings come once."""

    def handle(batch: DataFrame, number: int) -> None:
        done = review(batch, settings, **options)
        done.findings.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        done.errors.write.mode("overwrite").parquet(f"{out}/errors/batch={number}")

    return diffs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and their sum by type in tumbling windows, with a watermark."""
    from pyspark.sql import functions as F

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
