"""Per-tag time series: duplicate resolution, grid, interpolation, jumps.

All scans are keyed by (source, tag_id) and go through :func:`scan.look`, so a
plan that chains them shuffles once and sorts once before the grid and once in it.
``slab`` cuts tracks of more positions than a task should hold.  Rows without a
source or a tag have no track and go when duplicates are resolved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators import quantiles as q
from waymark.operators.scan import look
from waymark.schema import CORNERS, INTERPOLATED, NONE, ORIGINAL, TRACK, EmptyTrackingError

_KEYS = ("source", "frame", "tag_id", "det_id")


def _line(p: Column, n: Column, at: Column, pa: Column, na: Column) -> Column:
    return p + (n - p) * (at - pa) / (na - pa)


def by_track(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by track to as many tasks as the session shuffles to; a number that is asked for isn't coalesced at run time.

    Detections are few bytes, but the grid that grows from them in the same
    stage has a row a frame.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *TRACK)


def resolve_duplicates(detections: DataFrame, slab: int | None = None) -> DataFrame:
    """One detection a (source, tag, frame): of several, the nearest to the track of unambiguous frames.

    The track is linear between single detections and constant beyond them; ties,
    and tags without a single detection, take the lowest ``det_id``.
    """
    columns, order = detections.columns, ("frame", "det_id")
    d = detections.where("source IS NOT NULL AND tag_id IS NOT NULL")
    d = by_track(d) if slab is None else d
    alike = Window.partitionBy(*TRACK, "frame")
    in_turn = alike.orderBy("det_id")  # one sort serves all windows, as this one comes first
    every = in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumns({"_nth": F.row_number().over(in_turn), "_one": F.count("*").over(every) == 1})
    known = {c: F.when(F.col("_one"), F.col(c)) for c in ("frame", "center_x", "center_y")}
    d = look(d, {f"_p_{c}": v for c, v in known.items()}, {f"_n_{c}": v for c, v in known.items()}, order=order, slab=slab)

    def expected(c: str) -> Column:
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        both = F.col("_p_frame").isNotNull() & F.col("_n_frame").isNotNull()
        return F.when(both, _line(p, n, F.col("frame"), F.col("_p_frame"), F.col("_n_frame"))).otherwise(F.coalesce(p, n))

    dx, dy = F.col("center_x") - expected("center_x"), F.col("center_y") - expected("center_y")
    off = F.when(F.col("_one"), F.lit(0.0)).otherwise(dx * dx + dy * dy)
    best = d.withColumn("_d", F.struct(off.isNull().alias("unknown"), off.alias("off"), F.col("_nth").alias("nth")))
    return best.withColumn("_best", F.min("_d").over(alike)).where(F.col("_best") == F.col("_d")).select(*columns)


def dense_grid(detections: DataFrame, n_frames: int | None = None, raw: DataFrame | None = None, slab: int | None = None) -> DataFrame:
    """A row for each frame of each tag; ``pos`` is its dense position.

    ``detections`` has one row a (source, tag, frame).  With ``n_frames`` the
    grid is 0 .. n_frames - 1 and other frames go: each detection then brings
    the empty frames up to the next one along, without a join.  Without, it has
    the frames of the source with any detection.  ``raw``, the detections before
    duplicates were resolved, has the same tags and frames: read there, the plan
    of ``detections`` runs once.
    """
    values = [c for c in detections.columns if c not in _KEYS]
    if n_frames is not None and slab is None:
        return _filled_up(detections, n_frames).select("source", "frame", "pos", "tag_id", *values)
    keys = detections if raw is None else raw.where("source IS NOT NULL AND tag_id IS NOT NULL")
    tags = keys.select(*TRACK).distinct()
    if n_frames is not None:
        starts = tags.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(n_frames - 1), F.lit(slab))))
        stop = F.least(F.col("_start") + slab, F.lit(n_frames)) - 1
        grid = starts.repartition(*TRACK, "_start").select(*TRACK, F.explode(F.sequence("_start", stop)).alias("frame")).withColumn("pos", F.col("frame"))
    else:
        grid = tags.join(frame_positions(keys, slab), "source").select(*TRACK, F.explode("_f").alias("f")).select(*TRACK, "f.pos", "f.frame")
    joined = grid.join(detections.select("source", "tag_id", "frame", *values).hint("merge"), [*TRACK, "frame"], "left")  # no lookup, however small its files
    return joined.select("source", "frame", "pos", "tag_id", *values)


def _filled_up(detections: DataFrame, n_frames: int) -> DataFrame:
    """Each detection with the frames up to the next one; a tag's first one also with those before it."""
    w = Window.partitionBy(*TRACK).orderBy("frame")
    d = detections.withColumns({"_next": F.lead("frame").over(w), "_nth": F.row_number().over(w)})
    start = F.when(F.col("_nth") == 1, F.lit(0)).otherwise(F.greatest("frame", F.lit(0)))
    stop = F.least(F.coalesce("_next", F.lit(n_frames)), F.lit(n_frames)) - 1
    none = F.array().cast("array<int>")
    d = d.withColumn("pos", F.explode(F.when(start <= stop, F.sequence(start.cast("int"), stop.cast("int"))).otherwise(none)))
    own = F.col("pos") == F.col("frame")
    values = {c: F.when(own, F.col(c)) for c in detections.columns if c not in _KEYS}
    return d.withColumns(values).withColumn("frame", F.col("pos"))


def frame_positions(detections: DataFrame, slab: int | None = None) -> DataFrame:
    """Per source, in runs of at most ``slab`` frames (65,536 unless given): ``_f``, an array of (pos, frame) of its frames with any detection.

    Frames are numbered within runs of frame numbers; only a count a run is summed up along the recording.
    """
    width = slab or 1 << 16
    frames = detections.where("frame IS NOT NULL").select("source", "frame").distinct().withColumn("_run", F.floor(F.col("frame") / width))
    runs = frames.groupBy("source", "_run").agg(F.array_sort(F.collect_list("frame")).alias("_frames"))  # a run has at most ``width`` frames
    before = F.coalesce(F.sum(F.size("_frames")).over(Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    numbered = F.transform("_frames", lambda f, k: F.struct((F.col("_before") + k).alias("pos"), f.alias("frame")))
    return runs.withColumn("_before", before).select("source", numbered.alias("_f"))


def min_detections(cells: DataFrame, least: int, slab: int | None = None) -> DataFrame:
    """Tags with at least ``least`` positions."""
    if slab is not None:
        tags = cells.groupBy(*TRACK).agg(F.count("center_x").alias("_n")).where(F.col("_n") >= least)
        return cells.join(tags.select(*TRACK), [*TRACK], "left_semi")
    n = F.count("center_x").over(Window.partitionBy(*TRACK))
    return cells.withColumn("_n", n).where(F.col("_n") >= least).drop("_n")


def require_rows(df: DataFrame, what: str = "no tag has enough detections") -> DataFrame:
    if df.isEmpty():
        raise EmptyTrackingError(what)
    return df


def stamp_original(cells: DataFrame) -> DataFrame:
    return cells.withColumn("ass_type", F.when(F.col("center_x").isNotNull(), ORIGINAL).otherwise(NONE))


def stamp_interpolated(cells: DataFrame) -> DataFrame:
    filled = (F.col("ass_type") == NONE) & F.col("center_x").isNotNull()
    return cells.withColumn("ass_type", F.when(filled, INTERPOLATED).otherwise(F.col("ass_type")))


def interpolate(cells: DataFrame, limit: int, way: str = "asc", slab: int | None = None, moves: bool = False, steps: bool = False) -> DataFrame:
    """Fill inner gaps linearly, up to ``limit`` cells from each end of a gap.

    The same scan gives with ``moves`` what :func:`with_moves` tells of the cells as given, and with ``steps`` what :func:`step_distance` tells of
    the filled ones: an unknown cell before a row lies in a gap with the same start, which ends at the row if it is known.
    """
    before, after, prev, filled, step = {}, {}, _last() if moves else {}, {}, {}
    if steps:
        prev |= {"_q_pos": F.col("pos"), "_px": F.col("center_x"), "_py": F.col("center_y")}
    for c in ("center_x", "center_y"):
        ends = {"at": F.when(F.col(c).isNotNull(), F.col("pos")), "v": F.col(c)}
        before |= {f"_p_{c}_{k}": v for k, v in ends.items()}
        after |= {f"_n_{c}_{k}": v for k, v in ends.items()}
        pa, pv, na, nv = (F.col(f"_{e}_{c}_{k}") for e in "pn" for k in ("at", "v"))

        def at(own: Column, pos: Column, na: Column, nv: Column, pa: Column = pa, pv: Column = pv) -> Column:
            near = (pos - pa <= limit) | (na - pos <= limit)
            return F.when(own.isNull() & near, _line(pv, nv, pos, pa, na)).otherwise(own)

        filled[c] = at(F.col(c), F.col("pos"), na, nv)
        if steps:
            step[c] = filled[c] - at(F.col(f"_p{c[-1]}"), F.col("_q_pos"), F.coalesce(ends["at"], na), F.coalesce(c, nv))
    more = {"move_px": _moved()} if moves else {}
    more |= {"distance": F.sqrt(step["center_x"] * step["center_x"] + step["center_y"] * step["center_y"])} if steps else {}
    c = look(cells, before, after, prev, way=way, slab=slab)  # both axes in one window a direction
    return c.withColumns(more | filled).drop(*before, *after, *prev)


def step_distance(cells: DataFrame, way: str = "asc", slab: int | None = None) -> DataFrame:
    """Distance to the position before; null if either is unknown."""
    c = look(cells, prev={"_px": F.col("center_x"), "_py": F.col("center_y")}, way=way, slab=slab)
    dx, dy = F.col("center_x") - F.col("_px"), F.col("center_y") - F.col("_py")
    return c.withColumn("distance", F.sqrt(dx * dx + dy * dy)).drop("_px", "_py")


def drop_jumps(cells: DataFrame, max_jump: float, way: str = "asc", slab: int | None = None) -> DataFrame:
    """Clear runs of steps over ``max_jump``, but for the last original cell of each.

    An interpolated cell right before a run goes too.  All decisions look at the
    cells as given: an original cell is the last of its run if a step that isn't
    over comes before the next original one or is it.  Column ``jump_deleted`` tells
    which positions were lost.
    """
    c = cells.withColumn("_over", F.coalesce(F.col("distance") > max_jump, F.lit(False)))
    original, calm = F.when(F.col("ass_type") == ORIGINAL, F.col("pos")), F.when(~F.col("_over"), F.col("pos"))
    c = look(c, after={"_original": original, "_calm": calm}, following={"_next": F.col("_over")}, way=way, slab=slab)
    last = (F.col("ass_type") == ORIGINAL) & (F.col("_original").isNull() | F.coalesce(F.col("_calm") <= F.col("_original"), F.lit(False)))
    ahead = ~F.col("_over") & F.coalesce("_next", F.lit(False)) & (F.col("ass_type") == INTERPOLATED)
    c = c.withColumn("_cut", (F.col("_over") & ~last) | ahead).withColumn("jump_deleted", F.col("_cut") & F.col("center_x").isNotNull())
    new = {v: F.when(~F.col("_cut"), F.col(v)) for v in ("center_x", "center_y", "distance")}
    return c.withColumns(new | {"ass_type": F.when(F.col("_cut"), NONE).otherwise(F.col("ass_type"))}).drop("_over", "_original", "_calm", "_next", "_cut")


def clear_corners(cells: DataFrame) -> DataFrame:
    """Corners belong to original cells only."""
    have = [c for c in CORNERS if c in cells.columns]
    return cells.withColumns({c: F.when(F.col("ass_type") == ORIGINAL, F.col(c)) for c in have})


def with_moves(cells: DataFrame, way: str = "asc", slab: int | None = None) -> DataFrame:
    """Column ``move_px``: the step between originals of consecutive frames, null elsewhere."""
    last = _last()
    return look(cells, prev=last, way=way, slab=slab).withColumn("move_px", _moved()).drop(*last)


def _last() -> dict[str, Column]:
    return {"_kind": F.col("ass_type"), "_frame": F.col("frame"), "_px": F.col("center_x"), "_py": F.col("center_y")}


def _moved() -> Column:
    both = (F.col("ass_type") == ORIGINAL) & (F.col("_kind") == ORIGINAL) & (F.col("frame") - F.col("_frame") == 1)
    dx, dy = F.col("center_x") - F.col("_px"), F.col("center_y") - F.col("_py")
    return F.when(both, F.sqrt(dx * dx + dy * dy))


def max_move(cells: DataFrame) -> DataFrame:
    """Of each source the 99th percentile of ``move_px``; infinite if there are no moves."""
    bits = q.ordered_bits(F.col("move_px"))
    counts = with_moves(cells).groupBy("source", bits.alias("bits")).agg(F.count("*").alias("_n"))
    moves = counts.select("source", "bits", F.when(F.col("bits").isNull(), F.lit(0).cast("long")).otherwise(F.col("_n")).alias("n"))
    limits = q.of_counts(moves, ["source"], {"max_move_px": 0.99}).withColumnRenamed("source", "_s")
    every = counts.groupBy("source").agg(F.sum("_n").alias("_n"))  # reads the same shuffle
    return every.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", F.coalesce("max_move_px", F.lit(float("inf"))).alias("max_move_px"))


def enclosing_originals(cells: DataFrame, slab: int | None = None) -> DataFrame:
    """Cells with the positions of the nearest originals before and after them (``prev_original``, ``next_original``; null if none)."""
    at = F.when(F.col("ass_type") == ORIGINAL, F.col("pos"))
    return look(cells, {"prev_original": at}, {"next_original": at}, slab=slab)


def gap_runs(cells: DataFrame, longer_than: int, slab: int | None = None) -> DataFrame:
    """Gaps known on both sides and longer than ``longer_than``: first and last position and length."""
    known = F.when(F.col("center_x").isNotNull(), F.col("pos"))
    c = look(cells.select(*TRACK, "pos", "center_x"), {"_p": known}, {"_n": known}, slab=slab)
    gaps = c.where("center_x IS NULL AND _p IS NOT NULL AND _n IS NOT NULL").groupBy(*TRACK, "_p", "_n").agg(F.count("*").alias("length"))
    return gaps.where(F.col("length") > longer_than).select(*TRACK, (F.col("_p") + 1).alias("gap_start"), (F.col("_n") - 1).alias("gap_end"), "length")
