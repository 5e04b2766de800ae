"""Many recordings together: attributes, scale, global frame numbers, render tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import quantiles as q
from waymark.operators.trajectory import by_track
from waymark.schema import BOX_INFERRED, TRACK


def merge_attributes(attributes: DataFrame) -> DataFrame:
    """Per key (of source, key, value rows) the one value of all sources, or the list of values in source order.

    A key that a source lacks counts as a null value there.
    """
    sources = sorted(r["source"] for r in attributes.select("source").distinct().collect())  # the list of recordings
    per = attributes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("source", "value"))).alias("m"))
    listed = per.select("key", F.transform(F.array(*[F.lit(s) for s in sources]), lambda s: F.try_element_at("m", s)).alias("values"))
    same = F.size(F.array_distinct("values")) <= 1
    return listed.select("key", F.when(same, F.get("values", F.lit(0))).alias("value"), F.when(~same, F.col("values")).alias("values"), (~same).alias("varies"))


def median_scale(scales: DataFrame) -> DataFrame:
    """Median mm per pixel over the recordings that have one; a NaN makes it NaN."""
    known = scales.where("mm_per_px IS NOT NULL").select(F.lit(1).alias("_all"), "mm_per_px")
    middle = q.quantiles(known, ["_all"], "mm_per_px", {"mm_per_px": 0.5})
    odd = known.agg(F.max(F.isnan("mm_per_px")).alias("_nan"))
    return odd.join(middle, F.lit(True), "left").select(F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("mm_per_px")).alias("mm_per_px"))  # one row each


def global_frames(frames: DataFrame) -> DataFrame:
    """``frame`` counted over all sources in name order, and ``video_frame`` within its own.

    Offsets are summed over one row a source; rows are ranked within their source.
    """
    rank = F.row_number().over(Window.partitionBy("source").orderBy("frame")) - 1
    sizes = frames.groupBy("source").agg(F.count("*").alias("n"))
    in_order = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)  # over one row a source
    before = sizes.select("source", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("_offset"))
    ranked = frames.withColumn("_k", rank).join(before, "source")
    return ranked.select((F.col("_offset") + F.col("_k")).alias("global_frame"), "source", F.col("frame").alias("video_frame"))


def to_mm(value: Column, mm_per_px: Column) -> Column:
    return value * mm_per_px


#: Thickness of a trail's positions, known or not, by how many of its oldest frames lie before: ten thin ones, ten middle ones, then thick.
RAMP = ((10, 1), (20, 2))
THICKEST = 3


def _with_points(cells: DataFrame, point: Column, length: int, skip: int) -> tuple[DataFrame, list[tuple[int, Column, Column]]]:
    """``cells`` with the known points of a block of ``length`` rows and of the block before it (``_near``, in order), and for each
    thickness, of the oldest first, where in ``_near`` its points begin and how many they are.

    A list is made once a block and not once a row; running counts tell each row its part of it.
    """
    known = F.when(F.col("center_x").isNotNull() & F.col("center_y").isNotNull(), point)
    size = max(length, 1)
    rows = by_track(cells).withColumns({"_block": F.floor(F.col("pos") / size), "_point": known})  # no further shuffle if cells come by track
    block, track = Window.partitionBy(*TRACK, "_block").orderBy("pos"), Window.partitionBy(*TRACK).orderBy("_block", "pos")  # one sort for both
    rows = rows.withColumns({
        "_own": F.collect_list("_point").over(block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        "_in_own": F.count("_point").over(block.rowsBetween(Window.unboundedPreceding, 0)),
    })
    upto = lambda back: F.count("_point").over(track.rowsBetween(Window.unboundedPreceding, -back))
    edges = [min(e, length - skip + 1) for e in (0, RAMP[0][0], RAMP[1][0], length - skip + 1)]
    rows = rows.withColumns({"_older": F.lag("_own", size).over(track), "_upto": upto(0)} | {f"_e{k}": upto(length - e + 1) for k, e in enumerate(edges)})
    none = F.col("_older").isNull()  # in the first block
    before = F.col("_upto") - F.col("_in_own")
    rows = rows.withColumns({"_first": F.when(none, before).otherwise(before - F.size("_older")), "_near": F.when(none, F.col("_own")).otherwise(F.concat("_older", "_own"))})
    parts = [(t, (F.col(f"_e{k}") - F.col("_first") + 1).cast("int"), (F.col(f"_e{k + 1}") - F.col(f"_e{k}")).cast("int")) for k, t in enumerate((RAMP[0][1], RAMP[1][1], THICKEST))]
    return rows.drop("_block", "_point", "_own", "_in_own", "_older", "_upto"), parts


def trails(cells: DataFrame, length: int = 50, skip: int = 4) -> DataFrame:
    """Positions that a renderer draws behind a tag: ``length`` to ``skip`` frames back, oldest first, each with its ``thickness``; ``pos`` is dense."""
    rows, parts = _with_points(cells, F.struct("center_x", "center_y"), length, skip)
    (thin, start, n1), (middle, _, n2), (thick, _, n3) = parts
    thickness = lambda k: F.when(k < n1, thin).when(k < n1 + n2, middle).otherwise(thick)
    placed = F.transform(F.slice("_near", start, n1 + n2 + n3), lambda q, k: F.struct(q["center_x"].alias("center_x"), q["center_y"].alias("center_y"), thickness(k).alias("thickness")))
    return rows.select(*cells.columns, F.when(F.col("pos") > length + skip, placed).alias("trail"))


def with_trail_lines(cells: DataFrame, point: Column, length: int = 50, skip: int = 4) -> tuple[DataFrame, dict[int, Column]]:
    """``cells``, and for each thickness the ``point`` of the trail's positions that are drawn with it; null if there are none."""
    rows, parts = _with_points(cells, point, length, skip)
    return rows, {t: F.when((F.col("pos") > length + skip) & (n > 0), F.slice("_near", start, n)) for t, start, n in parts}


def box_states(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """``state`` of each box: decoded, inferred (a box-inferred cell lies on it, to a tenth) or open."""
    key = lambda: (F.bround(F.col("center_x"), 1).alias("_x"), F.bround(F.col("center_y"), 1).alias("_y"))
    used = cells.where(F.col("ass_type") == BOX_INFERRED).select("source", "frame", *key()).distinct().withColumn("_used", F.lit(True))
    b = boxes.select("*", *key()).join(used, ["source", "frame", "_x", "_y"], "left")
    return b.withColumn("state", F.when(F.col("decoded"), "decoded").when(F.col("_used"), "inferred").otherwise("open")).drop("_x", "_y", "_used")
