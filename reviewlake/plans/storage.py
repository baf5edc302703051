"""Results that a plan uses more than once, written once to the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a written result go with the query that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: dict[str, str] = {}
_local: dict[str, str] = {}


def shared_root(spark: SparkSession, checkpoints: bool = False) -> str:
    """The folder that spark.checkpoint.dir names.  Where it is unset a local one
    serves sessions of one machine; on a cluster that is an error, since each
    executor would write to its own disk."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="reviewlake-"))
    if checkpoints and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again: no branch recomputes it,
    and a lost executor costs a re-read.  `forget` deletes it; what isn't
    forgotten goes with the application (`sweep`)."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes stored results that nothing will read again."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            _delete(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Deletes all that `stored` has written in this application."""
    path = _paths.pop(spark.sparkContext.applicationId, None)
    if path:
        _delete(spark, path)


def _folder(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _paths:
        _paths[app] = f"{shared_root(spark)}/reviewlake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_at_exit, spark)
    return _paths[app]


def _at_exit(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            sweep(spark)
    except Exception:  # noqa: BLE001  the session may have ended already
        return


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
