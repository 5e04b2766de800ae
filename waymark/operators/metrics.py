"""Quality metrics and the pixel scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import quantiles as q
from waymark.schema import BOX_INFERRED, CORNERS, INTERPOLATED, NONE, TRACK


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)


_EXTRA = {"yolo_filled_count": "n_filled", "yolo_pruned_count": "n_pruned", "yolo_rechained_count": "n_rechained", "long_gap_recovered_count": "n_recovered", "final_jump_deleted_count": "n_final_deleted"}


def metric_sums(cells: DataFrame) -> dict[str, Column]:
    """The counts from which :func:`quality_metrics` follows, as aggregates over cells."""
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    return {
        "total_samples": F.count("*"),
        "original_good_count": count(F.col("was_original")),
        "original_bad_count": count(F.col("n_deleted")),
        "final_count": count(F.col("ass_type") != NONE),
        "filled_count": count(F.col("ass_type") == INTERPOLATED),
        "yolo_inferred_count": count(F.col("ass_type") == BOX_INFERRED),
    } | {k: count(F.col(c)) if c in cells.columns else F.lit(0).cast("long") for k, c in _EXTRA.items()}


def quality_metrics(cells: DataFrame) -> DataFrame:
    """One row a source, from final cells with ``was_original`` and the number of deletions ``n_deleted`` each.

    ``n_pruned``, ``n_rechained``, ``n_recovered`` and ``n_final_deleted`` are
    taken if there; without boxes they are 0.  ``max_move_px`` is the 99th
    percentile of ``move_px``, infinite without any.  The counts are made a
    source and length of move first: sums and the percentile's histograms read
    this one shuffle, so the plan of ``cells`` runs once.
    """
    sums = metric_sums(cells)
    bits = q.ordered_bits(F.col("move_px")) if "move_px" in cells.columns else F.lit(None).cast("long")
    # as one text, of which no reader can drop a part: all read the same shuffle
    per = cells.groupBy("source", bits.alias("bits")).agg(F.concat_ws(",", *[c.cast("string") for c in sums.values()]).alias("_v"))
    per = per.withColumn("_v", F.split("_v", ",").cast("array<bigint>"))
    a = per.groupBy("source").agg(*[F.sum(F.get("_v", F.lit(k))).alias(name) for k, name in enumerate(sums)])
    moves = per.select("source", "bits", F.when(F.col("bits").isNull(), F.lit(0).cast("long")).otherwise(F.get("_v", F.lit(0))).alias("n"))
    limits = q.of_counts(moves, ["source"], {"max_move_px": 0.99})
    a = a.join(limits.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    a = a.withColumn("max_move_px", F.coalesce("max_move_px", F.lit(float("inf"))))
    s, g, j = F.col("total_samples"), F.col("original_good_count"), F.col("original_bad_count")
    a = a.withColumn("original_missing_count", s - g).withColumn("total_detections", g + j)
    a = a.withColumn("total_gaps", F.col("original_missing_count") + j)
    return a.withColumns({
        "error_pct": _percent(j, F.col("total_detections")),
        "original_bad_pct": _percent(j, s),
        "original_missing_pct": _percent(F.col("original_missing_count"), s),
        "filled_pct_of_total": _percent(F.col("filled_count"), s),
        "filled_pct_of_gaps": _percent(F.col("filled_count"), F.col("total_gaps")),
        "yolo_inferred_pct_of_gaps": _percent(F.col("yolo_inferred_count"), F.col("total_gaps")),
    })


def corner_sides() -> Column:
    """The four side lengths of a quad."""
    x = [F.col(f"c{k}x").cast("double") for k in range(4)]
    y = [F.col(f"c{k}y").cast("double") for k in range(4)]
    return F.array(*[F.sqrt((x[(k + 1) % 4] - x[k]) ** 2 + (y[(k + 1) % 4] - y[k]) ** 2) for k in range(4)])


def pixel_scale(detections: DataFrame, tag_mm: float = 0.4, max_quads: int = 5000) -> DataFrame:
    """tag_px, mm_per_px and n_quads of each source: median side over quads evenly spread over each tag's.

    Every tag gives at most ``ceil(max_quads / tags)`` quads, so the sample is bounded.
    """
    finite = F.lit(True)
    for c in CORNERS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c)
    tags = detections.groupBy("source").agg(F.ceil(F.lit(float(max_quads)) / F.countDistinct("tag_id")).cast("long").alias("_k"))
    quads = detections.where(finite)
    order = Window.partitionBy(*TRACK).orderBy("frame", "det_id")
    q = quads.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*TRACK))).join(tags, "source")
    # position i is picked if it equals floor(j (n - 1) / (k - 1)) for some j
    n, k, i = F.col("_n"), F.col("_k"), F.col("_i")
    j = F.ceil(i * (k - 1) / F.greatest(n - 1, F.lit(1)))
    spread = F.floor(j * (n - 1) / F.greatest(k - 1, F.lit(1))) == i
    picked = q.where((n <= k) | F.when(k == 1, i == 0).otherwise(spread & (j <= k - 1)))
    sides = picked.select("source", F.explode(corner_sides()).alias("side"))
    scale = sides.groupBy("source").agg(F.percentile("side", F.lit(0.5)).alias("tag_px"), (F.count("*") / 4).cast("long").alias("n_quads"))  # a bounded sample
    every = detections.select("source").distinct().join(scale, "source", "left")
    return every.select("source", "tag_px", F.when(F.col("tag_px") > 0, tag_mm / F.col("tag_px")).alias("mm_per_px"), F.coalesce("n_quads", F.lit(0).cast("long")).alias("n_quads"))


def counts_per_frame(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("source", "frame").agg(F.count("*").alias("n_boxes"))


def visible_tags(cells: DataFrame) -> DataFrame:
    """Tags with a position, for every frame."""
    return cells.groupBy("source", "frame").agg(F.count("center_x").alias("n_visible"))
