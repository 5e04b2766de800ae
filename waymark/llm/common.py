"""Small helpers shared by the operators: tables, scratch space, skew-safe joins."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
WHITE = r"[\x20\x09-\x0D]+"

#: A side of at most this many rows (of fixed-width columns) may be broadcast.
BROADCAST_ROWS = 100_000

#: Arrow batches on the way to Python hold about so many bytes, so that workers stay small whatever the rows' width.
BATCH_BYTES = "2m"
_SPARK_BATCH_BYTES = "67108864b"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_local_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Let local Python workers import this package, wherever the driver was started, and bound their batches.

    A session's own ``spark.sql.execution.arrow.maxBytesPerBatch`` stays as it is.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", _SPARK_BATCH_BYTES) == _SPARK_BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all of {master} share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="waymark-"))
        folder = f"file://{_local_scratch[0]}"
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder.

    Used instead of :func:`settle` where rows are wide and later readers need
    only some columns.  The folder goes with :func:`drop_table`, or when the
    driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.scratch_path = path
    return kept


def drop_table(df: DataFrame) -> None:
    """Delete what :func:`settle_table` returned; nothing that is still to run may read it."""
    _delete(df.sparkSession, df.scratch_path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # at exit the JVM may be gone already; the shared folder's owner clears the rest
        pass


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst inlines projections into lambdas, which would evaluate ``value``
    anew for every array element; a lambda variable is bound once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def join_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], n_lookup: int, spread: Column, salts: int = 16) -> DataFrame:
    """Left join of ``rows`` to one lookup row a key; safe if one key holds most rows.

    ``n_lookup`` is the counted size of ``lookup``: up to ``BROADCAST_ROWS`` it is
    broadcast, beyond that both sides are salted, ``rows`` by ``spread``.
    """
    if n_lookup <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lookup), keys, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


#: Rows of one key that a task may get in :func:`join_spread`.
SPREAD_ROWS = 4096


def join_spread(rows: DataFrame, lookup: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join of ``rows``, of which one key may hold most, to a few wide ``lookup`` rows a key.

    Keys of over ``SPREAD_ROWS`` rows are counted first; their rows are dealt by
    ``by`` to as many salts as they need, and their lookup rows copied to each.
    ``rows`` is read twice.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > SPREAD_ROWS)
    hot = settle(hot.select(key, F.ceil(F.col("_n") / SPREAD_ROWS).cast("int").alias("_salts")))
    n_hot = hot.count()
    if not n_hot:
        return rows.join(lookup, key)
    if n_hot <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int"))
    copies = lookup.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), [key, "_salt"]).drop("_salt")
