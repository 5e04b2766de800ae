"""Tracking tables derived from the driver's ``lineitem``, for queries and benchmarks.

A line is an observation: returned lines play undecoded boxes, others decoded
tags.  Numbering is per source, so no window is without a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.trajectory import by_track
from waymark.schema import TRACK

N_FRAMES = 2500
_ORDER = ("l_shipdate", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _measures() -> list:
    return [
        (40.0 * (F.col("l_suppkey") % 50) + F.col("l_quantity")).alias("center_x"),
        (40.0 * F.floor(F.col("l_suppkey") / 50.0) + F.round(F.col("l_discount") * 100)).cast("double").alias("center_y"),
        (14 + F.col("l_linenumber") % 3).cast("double").alias("side"),
    ]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.expr("l_suppkey DIV 25")
    # numbered from the table's own columns alone: whatever a reader takes of the rest, all readers of a plan share one shuffle
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_ORDER).withColumn("_nth", F.row_number().over(Window.partitionBy(part).orderBy(*_ORDER)))
    return li.select(
        part.cast("string").alias("source"),
        F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).alias("frame"),
        F.col("_nth").cast("long").alias("obs_id"),
        F.col("l_suppkey").alias("tag_id"),
        *_measures(),
        (F.col("l_returnflag") == "R").alias("is_box"),
        F.col("l_tax").alias("tax"), "l_linenumber", F.year("l_shipdate").alias("year"),
    )


def _corners() -> list:
    signs = ((-1, 1), (1, 1), (1, -1), (-1, -1))
    return [(F.col(f"center_{a}") + F.col("side") * (s / 2)).cast("float").alias(f"c{k}{a}") for k, pair in enumerate(signs) for a, s in zip("xy", pair, strict=True)]


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).where(~F.col("is_box"))
    return o.select("source", "frame", F.col("obs_id").alias("det_id"), "tag_id", "center_x", "center_y", *_corners())


def track_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`detections` for readers to which ``det_id`` is an order within a track only.

    It is numbered within the track, in the same order, so the one shuffle by
    track serves the numbering and all scans of tracks, and boxes never travel.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("NOT l_returnflag = 'R'")
    named = li.withColumns({"source": F.expr("l_suppkey DIV 25").cast("string"), "tag_id": F.col("l_suppkey")}).select(*TRACK, *_ORDER)
    nth = F.row_number().over(Window.partitionBy(*TRACK).orderBy(*[c for c in _ORDER if c != "l_suppkey"]))  # a track has one l_suppkey
    o = by_track(named).withColumn("_nth", nth).select(
        "source", F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).alias("frame"), F.col("_nth").cast("long").alias("det_id"), "tag_id", *_measures(),
    )
    return o.select("source", "frame", "det_id", "tag_id", "center_x", "center_y", *_corners())


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir).where("is_box")
    half = F.col("side") / 2
    edges = [(F.col(f"center_{a}") + half * s).alias(f"box_{a}{k}") for k, s in ((1, -1), (2, 1)) for a in "xy"]
    return o.select("source", "frame", F.col("obs_id").alias("box_id"), *edges, "center_x", "center_y", (F.col("tax") * 10).alias("confidence"), F.lit(False).alias("decoded"), F.lit(-1).cast("long").alias("tag_id"))


def crop_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of single-label crops: experiment, frame, crop_idx, tag_id, ass_type."""
    o = observations(spark, sf_dir)
    return o.select(F.col("year").cast("string").alias("experiment"), "frame", F.col("obs_id").alias("crop_idx"), F.col("tag_id"), (1 + F.col("l_linenumber") % 3).cast("int").alias("ass_type"), "source")


def long_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track a line number along the order keys: few tags with many positions."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    source = F.col("l_linenumber").cast("string")
    x, y = F.col("l_quantity") + F.col("l_orderkey") % 7, F.round(F.col("l_discount") * 100)
    d = li.select(
        source.alias("source"), F.col("l_orderkey").cast("int").alias("frame"), F.row_number().over(Window.partitionBy("l_linenumber", "l_orderkey").orderBy(*_ORDER)).cast("long").alias("det_id"),
        F.lit(1).cast("long").alias("tag_id"), x.cast("double").alias("center_x"), y.cast("double").alias("center_y"), (14 + F.col("l_linenumber") % 3).cast("double").alias("side"),
    )
    return d.select("source", "frame", "det_id", "tag_id", "center_x", "center_y", *_corners())
