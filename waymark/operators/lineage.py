"""Where a plan forks into several reads, its rows are settled once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and the master is local."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all of {master} share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="waymark-"))
        folder = f"file://{_local[0]}"
    return folder


def settle(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, which survives the loss of executors.

    It is stored by columns: the empty cells of a grid take next to nothing, and
    readers load only the columns that they use.  The folder goes when the driver
    ends.

    Files stored so are a small part of their rows, by which Spark would take
    millions of rows for a lookup and collect them in the driver.  So joins of
    the table are by sort and merge.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at exit the JVM may be gone already; the shared folder's owner clears the rest
        pass
