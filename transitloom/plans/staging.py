"""Tables written to cut lineage.

A staged table is Parquet in the shared folder named by `spark.checkpoint.dir`, so that any executor can read it again
after another one is lost.  Where the setting is absent (tests), a temporary folder of this machine is used.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Seconds between two collections of garbage, which cost the driver a few tenths each.
RELEASE_SECONDS = 3.0
_own: dict[str, str] = {}
_released = 0.0


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="staged-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps: it does so for plans that the driver has collected."""
    global _released
    if time.monotonic() - _released < RELEASE_SECONDS:
        return
    _released = time.monotonic()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write `df` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    release(spark)  # of the steps before: one that has just ended may still be known to Spark's listeners
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
