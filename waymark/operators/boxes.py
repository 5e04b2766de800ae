"""Detector boxes: filters, crop layout, reprojection, non-maximum suppression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ("source", "frame")


def undecoded(boxes: DataFrame) -> DataFrame:
    return boxes.where(~F.col("decoded"))


def confident(boxes: DataFrame, least: float) -> DataFrame:
    return boxes.where(F.col("confidence") >= least)


def valid_ids(decodes: DataFrame, highest: int, silenced: tuple[int, ...] = ()) -> DataFrame:
    kept = decodes.where(F.col("tag_id") <= highest)
    return kept.where(~F.col("tag_id").isin(list(silenced))) if silenced else kept


def crop_layout(boxes: DataFrame, frame_width: int | Column, frame_height: int | Column, pad_ratio: float) -> DataFrame:
    """Padded, clamped integer crops, and where each starts in the frame's strip (in box order).

    The frame's size is a number, or a column of ``boxes``.

    Padding is a share of the box, at most that share of the frame's median box;
    halves round to even.
    """
    whole = Window.partitionBy(*FRAME)
    side = lambda lo, hi: F.col(hi) - F.col(lo)
    half_even = lambda c: F.bround(c).cast("int")
    c = boxes
    for axis, lo, hi, most in (("x", "box_x1", "box_x2", frame_width), ("y", "box_y1", "box_y2", frame_height)):
        cap = half_even(F.percentile(side(lo, hi), F.lit(0.5)).over(whole) * pad_ratio)
        a, b = F.col(lo).cast("int"), F.col(hi).cast("int")
        c = c.withColumn("_cap", cap).withColumn("_pad", F.least(half_even((b - a) * F.lit(pad_ratio)), F.col("_cap")))
        c = c.withColumns({f"crop_{axis}1": F.greatest(a - F.col("_pad"), F.lit(0)), f"crop_{axis}2": F.least(b + F.col("_pad"), F.lit(most))})
    width = F.col("crop_x2") - F.col("crop_x1")
    before = F.sum(width).over(whole.orderBy("box_id").rowsBetween(Window.unboundedPreceding, -1))
    return c.withColumn("strip_x", F.coalesce(before, F.lit(0)).cast("int")).drop("_cap", "_pad")


def strips(layout: DataFrame) -> DataFrame:
    """Size of each frame's strip."""
    return layout.groupBy(*FRAME).agg(F.max(F.col("crop_y2") - F.col("crop_y1")).alias("strip_height"), F.sum(F.col("crop_x2") - F.col("crop_x1")).cast("int").alias("strip_width"))


def decodes_to_boxes(decodes: DataFrame, layout: DataFrame) -> DataFrame:
    """Decodes (source, frame, decode_idx, tag_id, cx, cy in the strip) with their box and frame position.

    A decode left of the strip belongs to the first crop; beyond the end it is lost.
    """
    d, b = decodes.alias("d"), layout.alias("b")
    inside = (F.col("d.cx") < F.col("b.strip_x") + F.col("b.crop_x2") - F.col("b.crop_x1")) & ((F.col("d.cx") >= F.col("b.strip_x")) | (F.col("b.strip_x") == 0))
    on = (F.col("d.source") == F.col("b.source")) & (F.col("d.frame") == F.col("b.frame")) & inside
    joined = d.join(b, on).select("d.*", "b.box_id", "b.box_x1", "b.box_y1", "b.box_x2", "b.box_y2", (F.col("d.cx") + F.col("b.crop_x1") - F.col("b.strip_x")).alias("center_x"), (F.col("d.cy") + F.col("b.crop_y1")).alias("center_y"))
    first = Window.partitionBy("source", "frame", "decode_idx").orderBy(F.col("box_id").desc())  # of empty crops at one place, the last
    return joined.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def near_box_center(found: DataFrame, ratio: float) -> DataFrame:
    """Decodes within ``ratio`` of the box's shorter side from its centre; an infinite ratio keeps all."""
    if ratio == float("inf"):
        return found
    dx = F.col("center_x") - (F.col("box_x1") + F.col("box_x2")) / 2
    dy = F.col("center_y") - (F.col("box_y1") + F.col("box_y2")) / 2
    reach = F.least(F.col("box_x2") - F.col("box_x1"), F.col("box_y2") - F.col("box_y1")) * ratio
    return found.where(dx * dx + dy * dy <= reach * reach)


def all_boxes(boxes: DataFrame, found: DataFrame) -> DataFrame:
    """Every box with ``decoded`` and the id of its last decode (-1: none)."""
    last = found.groupBy(*FRAME, "box_id").agg(F.max_by("tag_id", "decode_idx").alias("_tag"))
    j = boxes.drop("decoded", "tag_id").join(last, [*FRAME, "box_id"], "left")
    return j.withColumns({"decoded": F.col("_tag").isNotNull(), "tag_id": F.coalesce("_tag", F.lit(-1).cast("long"))}).drop("_tag")


def lone_quads(quads: DataFrame, decoded: DataFrame) -> DataFrame:
    """Quads (with ``box_id``) of undecoded boxes that have exactly one."""
    n = F.count("*").over(Window.partitionBy(*FRAME, "box_id"))
    lone = quads.withColumn("_n", n).where("_n = 1").drop("_n")
    return lone.join(decoded.where("decoded").select(*FRAME, "box_id"), [*FRAME, "box_id"], "left_anti")


#: Frames that a call of the suppression kernel takes together.
FRAMES_A_CALL = 64


def suppress(boxes: DataFrame, iou: float, most: int = 300) -> DataFrame:
    """Greedy non-maximum suppression by frame and class, best first, at most ``most`` a frame.

    Ties go to the lower ``box_id``.  A kernel takes the frames of up to
    ``FRAMES_A_CALL`` numbers; in a round the best box left of every frame and
    class is kept and suppresses others, in all of them at once.
    """
    columns = boxes.columns

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        frame, kind = rows["frame"], rows["class_id"]
        odd = kind.isna()  # an unknown class is like no other
        rows = rows.assign(_kind=pd.factorize(kind)[0], _odd=np.where(odd, np.arange(len(rows)) + 1, 0), _frame=pd.factorize(frame)[0])
        rows = rows.sort_values(["_frame", "_kind", "_odd", "confidence", "box_id"], ascending=[True, True, True, False, True], kind="stable").reset_index(drop=True)
        group = np.cumsum((rows[["_frame", "_kind", "_odd"]].diff().fillna(0) != 0).any(axis=1).to_numpy())
        x1, y1, x2, y2 = (rows[c].to_numpy(float) for c in ("box_x1", "box_y1", "box_x2", "box_y2"))
        area = (x2 - x1) * (y2 - y1)
        left, kept = np.flatnonzero(rows["box_id"].notna().to_numpy()), []
        while len(left):
            lead = np.diff(group[left], prepend=-1) != 0
            leaders = left[lead]
            kept.append(leaders)
            k = leaders[np.cumsum(lead) - 1][~lead]
            left = left[~lead]
            wide = (np.minimum(x2[left], x2[k]) - np.maximum(x1[left], x1[k])).clip(min=0)
            high = (np.minimum(y2[left], y2[k]) - np.maximum(y1[left], y1[k])).clip(min=0)
            both = wide * high
            left = left[~(both > iou * (area[left] + area[k] - both))]
        found = rows.iloc[np.concatenate(kept) if kept else []].sort_values(["_frame", "confidence", "box_id"], ascending=[True, False, True], kind="stable")
        return found[found.groupby("_frame").cumcount() < most][columns]

    some = F.floor(F.col("frame") / FRAMES_A_CALL).alias("_some")
    return boxes.groupBy("source", some).applyInPandas(kernel, boxes.schema)
