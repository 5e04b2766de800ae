"""Column names, provenance codes and default parameters of tracking tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

NONE, ORIGINAL, INTERPOLATED, BOX_INFERRED = 0, 1, 2, 3

#: Written into the records of runs.
VERSION = "0.3"

CORNERS = ("c0x", "c0y", "c1x", "c1y", "c2x", "c2y", "c3x", "c3y")
TRACK = ("source", "tag_id")

_corner_fields = [T.StructField(c, T.FloatType()) for c in CORNERS]

DETECTIONS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("det_id", T.LongType()),
    T.StructField("tag_id", T.LongType()), T.StructField("center_x", T.DoubleType()), T.StructField("center_y", T.DoubleType()), *_corner_fields,
])
BOXES = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("box_id", T.LongType()),
    *[T.StructField(c, T.DoubleType()) for c in ("box_x1", "box_y1", "box_x2", "box_y2", "center_x", "center_y", "confidence")],
    T.StructField("decoded", T.BooleanType()), T.StructField("tag_id", T.LongType()),
])
CELLS = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("frame", T.IntegerType()), T.StructField("pos", T.IntegerType()),
    T.StructField("tag_id", T.LongType()), T.StructField("center_x", T.DoubleType()), T.StructField("center_y", T.DoubleType()),
    T.StructField("ass_type", T.IntegerType()), T.StructField("distance", T.DoubleType()), *_corner_fields,
])


@dataclass(frozen=True)
class CleanParams:
    """Settings of the cleaning plan."""

    min_detections: int = 100
    interp_limit: int = 5
    max_jump: float = 100.0
    n_frames: int | None = None
    yolo_fill: bool = True
    fill_limit: int = 0
    tag_size_multiplier: float = 2.0
    max_misses: int = 10
    rechain_affected_only: bool = False
    recover_long_gaps: bool = False
    min_gap: int = 10
    final_jump_pass: bool = False
    tag_mm: float = 0.4
    fail_if_empty: bool = False
    slab: int | None = None  # positions of a track that a task holds; None: whole tracks
    snapshots: str | None = None  # folder for the state after each step with boxes, for debugging


class TrackingError(Exception):
    """Base of this package's errors."""


class EmptyTrackingError(TrackingError):
    """There is nothing to clean; batch runs skip such a source."""
