"""Queries on the driver's tables and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import functions as g
from waymark.operators import boxes as bx
from waymark.operators import chains as ch
from waymark.operators import evaluate as ev
from waymark.operators import matching as mt
from waymark.operators import metrics as me
from waymark.operators import quads as qu
from waymark.operators import quantiles as qt
from waymark.operators import recordings as rec
from waymark.operators import sampling as sa
from waymark.operators import trajectory as tr
from waymark.functions import tables
from waymark.operators.lineage import settle, shared_folder
from waymark.operators.near import near_pairs
from waymark.plans import render, review
from waymark.plans.clean import clean, clean_cells, clean_to
from waymark.schema import CORNERS, TRACK, VERSION, CleanParams
from waymark.sources import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MIN_DETECTIONS, LIMIT, MAX_JUMP, SAMPLE = 350, 5, 30.0, 40
PARAMS = CleanParams(min_detections=MIN_DETECTIONS, interp_limit=LIMIT, max_jump=MAX_JUMP, n_frames=views.N_FRAMES)
FRAME_W, FRAME_H, PAD = 2100, 900, 0.34


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# SQL fragments, each a list of common table expressions.
_OBS = f"""obs AS (
  SELECT CAST(l_suppkey // 25 AS VARCHAR) AS source, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS frame,
         row_number() OVER (PARTITION BY l_suppkey // 25 ORDER BY {", ".join(views._ORDER)}) AS obs_id, l_suppkey AS tag_id,
         CAST(40.0 * (l_suppkey % 50) + l_quantity AS DOUBLE) AS center_x, CAST(40.0 * floor(l_suppkey / 50.0) + round(l_discount * 100) AS DOUBLE) AS center_y,
         l_returnflag = 'R' AS is_box, CAST(14 + l_linenumber % 3 AS DOUBLE) AS side, l_tax AS tax, l_linenumber, year(l_shipdate) AS y
  FROM lineitem)"""
_DET = _OBS + """,
det AS (SELECT source, frame, obs_id AS det_id, tag_id, center_x, center_y, side FROM obs WHERE NOT is_box)"""
_BOX = _OBS + """,
box AS (SELECT source, frame, obs_id AS box_id, center_x - side / 2 AS box_x1, center_y - side / 2 AS box_y1, center_x + side / 2 AS box_x2, center_y + side / 2 AS box_y2, center_x, center_y, tax * 10 AS confidence FROM obs WHERE is_box)"""
_W1 = _DET + """,
w1a AS (SELECT *, count(*) OVER (PARTITION BY source, tag_id, frame) = 1 AS one FROM det),
w1b AS (SELECT *, CASE WHEN one THEN frame END AS f, CASE WHEN one THEN center_x END AS x, CASE WHEN one THEN center_y END AS yy FROM w1a),
w1c AS (SELECT *, last_value(f IGNORE NULLS) OVER p AS pf, last_value(x IGNORE NULLS) OVER p AS px, last_value(yy IGNORE NULLS) OVER p AS py,
               last_value(f IGNORE NULLS) OVER n AS nf, last_value(x IGNORE NULLS) OVER n AS nx, last_value(yy IGNORE NULLS) OVER n AS ny
        FROM w1b WINDOW p AS (PARTITION BY source, tag_id ORDER BY frame, det_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                        n AS (PARTITION BY source, tag_id ORDER BY frame DESC, det_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w1d AS (SELECT *, center_x - CASE WHEN pf IS NOT NULL AND nf IS NOT NULL THEN px + (nx - px) * (frame - pf) / (nf - pf) ELSE coalesce(px, nx) END AS dx,
                  center_y - CASE WHEN pf IS NOT NULL AND nf IS NOT NULL THEN py + (ny - py) * (frame - pf) / (nf - pf) ELSE coalesce(py, ny) END AS dy FROM w1c),
w1 AS (SELECT source, frame, det_id, tag_id, center_x, center_y, side FROM (
         SELECT *, row_number() OVER (PARTITION BY source, tag_id, frame ORDER BY CASE WHEN one THEN 0.0 ELSE dx * dx + dy * dy END NULLS LAST, det_id) AS k FROM w1d) WHERE k = 1)"""
_GRID = _W1 + f""",
grid AS (SELECT t.source, t.tag_id, CAST(f.f AS INTEGER) AS frame, CAST(f.f AS INTEGER) AS pos FROM (SELECT DISTINCT source, tag_id FROM w1) t, range({views.N_FRAMES}) f(f)),
g AS (SELECT grid.source, grid.frame, grid.pos, grid.tag_id, w1.center_x, w1.center_y, w1.side FROM grid LEFT JOIN w1 USING (source, tag_id, frame)),
f2 AS (SELECT * FROM (SELECT *, count(center_x) OVER (PARTITION BY source, tag_id) AS n FROM g) WHERE n >= {MIN_DETECTIONS}),
s0 AS (SELECT source, frame, pos, tag_id, center_x, center_y, side, CASE WHEN center_x IS NOT NULL THEN 1 ELSE 0 END AS ass_type, center_x IS NOT NULL AS was_original FROM f2)"""


def _interpolated(src: str, out: str) -> str:
    """W3 of ``src`` with new cells stamped."""
    return f""",
{out}a AS (SELECT *, CASE WHEN center_x IS NOT NULL THEN pos END AS kp FROM {src}),
{out}b AS (SELECT *, last_value(kp IGNORE NULLS) OVER p AS pp, last_value(center_x IGNORE NULLS) OVER p AS px, last_value(center_y IGNORE NULLS) OVER p AS py,
                  last_value(kp IGNORE NULLS) OVER n AS np, last_value(center_x IGNORE NULLS) OVER n AS nx, last_value(center_y IGNORE NULLS) OVER n AS ny
           FROM {out}a WINDOW p AS (PARTITION BY source, tag_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                              n AS (PARTITION BY source, tag_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{out}c AS (SELECT * REPLACE (CASE WHEN center_x IS NULL AND ok THEN px + (nx - px) * (pos - pp) / (np - pp) ELSE center_x END AS center_x,
                             CASE WHEN center_y IS NULL AND ok THEN py + (ny - py) * (pos - pp) / (np - pp) ELSE center_y END AS center_y)
           FROM (SELECT *, coalesce(pos - pp <= {LIMIT} OR np - pos <= {LIMIT}, false) AND pp IS NOT NULL AND np IS NOT NULL AS ok FROM {out}b)),
{out} AS (SELECT * EXCLUDE (kp, pp, px, py, np, nx, ny, ok) REPLACE (CASE WHEN ass_type = 0 AND center_x IS NOT NULL THEN 2 ELSE ass_type END AS ass_type) FROM {out}c)"""


def _stepped(src: str, out: str) -> str:
    return f""",
{out} AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance FROM (SELECT *, center_x - lag(center_x) OVER o AS dx, center_y - lag(center_y) OVER o AS dy FROM {src} WINDOW o AS (PARTITION BY source, tag_id ORDER BY pos)))"""


_JUMP = _GRID + _interpolated("s0", "i1") + _stepped("i1", "d1") + f""",
j1 AS (SELECT *, coalesce(distance > {MAX_JUMP}, false) AS ov FROM d1),
j2 AS (SELECT *, CAST(ov <> coalesce(lag(ov) OVER o, false) AS INT) AS turn, coalesce(lead(ov) OVER o, false) AS nxt FROM j1 WINDOW o AS (PARTITION BY source, tag_id ORDER BY pos)),
j3 AS (SELECT *, sum(turn) OVER (PARTITION BY source, tag_id ORDER BY pos) AS run FROM j2),
j4 AS (SELECT *, max(CASE WHEN ass_type = 1 THEN pos END) OVER (PARTITION BY source, tag_id, run) AS lst FROM j3),
j5 AS (SELECT *, (ov AND (lst IS NULL OR pos <> lst)) OR (NOT ov AND nxt AND ass_type = 2) AS cut FROM j4),
jump AS (SELECT source, frame, pos, tag_id, side, was_original, cut AND center_x IS NOT NULL AS jump_deleted,
                CASE WHEN NOT cut THEN center_x END AS center_x, CASE WHEN NOT cut THEN center_y END AS center_y,
                CASE WHEN NOT cut THEN distance END AS distance, CASE WHEN cut THEN 0 ELSE ass_type END AS ass_type FROM j5)"""
_CLEAN = _JUMP.replace("jump AS (", "jump0 AS (") + """,
jump AS (SELECT * EXCLUDE (distance) FROM jump0)""" + _interpolated("jump", "i2") + _stepped("i2", "fin")


def _grid(spark, d):
    detections = views.track_detections(spark, d)
    return tr.dense_grid(tr.resolve_duplicates(detections), views.N_FRAMES, detections)


def _stamped(spark, d):
    found = tr.resolve_duplicates(views.track_detections(spark, d)).where(F.col("frame").between(0, views.N_FRAMES - 1))
    return tr.stamp_original(tr.dense_grid(tr.min_detections(found, MIN_DETECTIONS), views.N_FRAMES))  # counted before the empty cells are there


def _filled(spark, d):
    return tr.stamp_interpolated(tr.interpolate(_stamped(spark, d), LIMIT))


@query(f"WITH {_W1} SELECT source, frame, tag_id, center_x, center_y FROM w1")
def dedup_continuity(spark: SparkSession, d: str) -> DataFrame:
    return tr.resolve_duplicates(views.track_detections(spark, d)).select("source", "frame", "tag_id", "center_x", "center_y")


@query(f"WITH {_GRID} SELECT source, tag_id, count(*) AS n_cells, count(center_x) AS n_known, max(pos) AS last_pos FROM g GROUP BY source, tag_id")
def dense_grid(spark, d):
    return _grid(spark, d).groupBy("source", "tag_id").agg(F.count("*").alias("n_cells"), F.count("center_x").alias("n_known"), F.max("pos").alias("last_pos"))


@query(f"WITH {_GRID} SELECT source, tag_id, count(center_x) AS n_known FROM f2 GROUP BY source, tag_id")
def min_detections(spark, d):
    return tr.min_detections(_grid(spark, d), MIN_DETECTIONS).groupBy("source", "tag_id").agg(F.count("center_x").alias("n_known"))


@query(f"WITH {_GRID} SELECT source, ass_type, count(*) AS n FROM s0 GROUP BY source, ass_type")
def stamp_provenance(spark, d):
    return _stamped(spark, d).groupBy("source", "ass_type").agg(F.count("*").alias("n"))


@query(f"WITH {_GRID}{_interpolated('s0', 'i1')} SELECT source, tag_id, pos, ass_type, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y FROM i1 WHERE center_x IS NOT NULL")
def interpolate_bounded(spark, d):
    return _round(_filled(spark, d).where("center_x IS NOT NULL").select("source", "tag_id", "pos", "ass_type", "center_x", "center_y"), "center_x", "center_y")


@query(f"WITH {_GRID}{_interpolated('s0', 'i1')}{_stepped('i1', 'd1')} SELECT source, tag_id, pos, round(distance, 6) AS distance FROM d1 WHERE distance IS NOT NULL")
def step_distance(spark, d):
    return _round(tr.step_distance(_filled(spark, d)).where("distance IS NOT NULL").select("source", "tag_id", "pos", "distance"), "distance")


@query(f"WITH {_JUMP} SELECT source, tag_id, pos, ass_type, jump_deleted, round(center_x, 6) AS center_x FROM jump WHERE jump_deleted OR center_x IS NOT NULL")
def jump_blocks(spark, d):
    cut = tr.drop_jumps(tr.step_distance(_filled(spark, d)), MAX_JUMP)
    return _round(cut.where("jump_deleted OR center_x IS NOT NULL").select("source", "tag_id", "pos", "ass_type", "jump_deleted", "center_x"), "center_x")


@query(f"WITH {_CLEAN} SELECT source, tag_id, frame, ass_type, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(distance, 6) AS distance FROM fin")
def clean_no_boxes(spark, d):
    cells, _ = clean(views.track_detections(spark, d), None, PARAMS)
    return _round(cells.select("source", "tag_id", "frame", "ass_type", "center_x", "center_y", "distance"), "center_x", "center_y", "distance")


_PCT = "CASE WHEN {1} > 0 THEN round(100.0 * ({0}) / ({1}), 6) ELSE 0.0 END"


@query(f"""WITH {_CLEAN}, a AS (
  SELECT source, count(*) AS s, count(*) FILTER (was_original) AS g, count(*) FILTER (jump_deleted) AS j, count(*) FILTER (ass_type <> 0) AS final_count, count(*) FILTER (ass_type = 2) AS filled FROM fin GROUP BY source),
l AS (SELECT *, lag(ass_type) OVER o AS pt, frame - lag(frame) OVER o AS df, center_x - lag(center_x) OVER o AS ddx, center_y - lag(center_y) OVER o AS ddy FROM s0 WINDOW o AS (PARTITION BY source, tag_id ORDER BY pos)),
mv AS (SELECT source, coalesce(quantile_cont(sqrt(ddx * ddx + ddy * ddy), 0.99) FILTER (ass_type = 1 AND pt = 1 AND df = 1), 'inf'::DOUBLE) AS mv FROM l GROUP BY source)
SELECT source, round(mv, 6) AS max_move_px, s AS total_samples, g AS original_good_count, j AS original_bad_count, final_count, filled AS filled_count, s - g AS original_missing_count, g + j AS total_detections, s - g + j AS total_gaps,
       {_PCT.format('j', '(g + j)')} AS error_pct, {_PCT.format('j', 's')} AS original_bad_pct, {_PCT.format('s - g', 's')} AS original_missing_pct,
       {_PCT.format('filled', 's')} AS filled_pct_of_total, {_PCT.format('filled', '(s - g + j)')} AS filled_pct_of_gaps FROM a JOIN mv USING (source)""")
def quality_metrics(spark, d):
    _, m = clean(views.track_detections(spark, d), None, PARAMS)
    counts = ["total_samples", "original_good_count", "original_bad_count", "final_count", "filled_count", "original_missing_count", "total_detections", "total_gaps"]
    shares = ["error_pct", "original_bad_pct", "original_missing_pct", "filled_pct_of_total", "filled_pct_of_gaps"]
    return _round(m.select("source", "max_move_px", *counts, *shares), "max_move_px", *shares)


@query(f"""WITH {_GRID}, l AS (SELECT *, lag(ass_type) OVER o AS pt, frame - lag(frame) OVER o AS df, center_x - lag(center_x) OVER o AS dx, center_y - lag(center_y) OVER o AS dy FROM s0 WINDOW o AS (PARTITION BY source, tag_id ORDER BY pos))
SELECT source, round(coalesce(quantile_cont(sqrt(dx * dx + dy * dy), 0.99) FILTER (ass_type = 1 AND pt = 1 AND df = 1), 'inf'::DOUBLE), 6) AS max_move_px FROM l GROUP BY source""")
def max_move_p99(spark, d):
    return _round(tr.max_move(_stamped(spark, d)), "max_move_px")


@query(f"""WITH {_GRID}{_interpolated('s0', 'i1')}{_stepped('i1', 'd1')}
SELECT source, ass_type, round(quantile_cont(distance, 0.001), 6) AS low, round(quantile_cont(distance, 0.5), 6) AS middle, round(quantile_cont(distance, 0.9), 6) AS p90, round(quantile_cont(distance, 0.999), 6) AS high
FROM d1 WHERE distance IS NOT NULL GROUP BY source, ass_type""")
def step_quantiles(spark, d):
    steps = tr.step_distance(_filled(spark, d), "desc")
    found = qt.quantiles(steps, ["source", "ass_type"], "distance", {"low": 0.001, "middle": 0.5, "p90": 0.9, "high": 0.999})
    return _round(found, "low", "middle", "p90", "high")


_LONG_DET = f"""det AS (
  SELECT CAST(l_linenumber AS VARCHAR) AS source, CAST(l_orderkey AS INTEGER) AS frame, row_number() OVER (PARTITION BY l_linenumber, l_orderkey ORDER BY {", ".join(views._ORDER)}) AS det_id, CAST(1 AS BIGINT) AS tag_id,
         CAST(l_quantity + l_orderkey % 7 AS DOUBLE) AS center_x, CAST(round(l_discount * 100) AS DOUBLE) AS center_y, CAST(14 + l_linenumber % 3 AS DOUBLE) AS side FROM lineitem)"""
_LONG = _CLEAN.replace(_DET, _LONG_DET).replace(f"range({views.N_FRAMES}) f(f)", "range((SELECT max(frame) + 1 FROM det)) f(f)")
SLAB = 8192


@query(f"WITH {_LONG} SELECT source, tag_id, frame, ass_type, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(distance, 6) AS distance FROM fin WHERE center_x IS NOT NULL")
def long_track_clean(spark, d):
    found = views.long_tracks(spark, d).drop(*CORNERS)  # not asked for, and each scan would settle and shuffle them
    last = found.agg(F.max("frame").alias("last")).first()["last"]
    cells, _ = clean(found, None, CleanParams(**(PARAMS.__dict__ | {"n_frames": last + 1, "slab": SLAB})))
    known = cells.where("center_x IS NOT NULL").select("source", "tag_id", "frame", "ass_type", "center_x", "center_y", "distance")
    return _round(known, "center_x", "center_y", "distance")


@query(f"""WITH {_DET}, k AS (SELECT source, ceil(5000.0 / count(DISTINCT tag_id))::BIGINT AS k FROM det GROUP BY source),
q AS (SELECT *, row_number() OVER (PARTITION BY source, tag_id ORDER BY frame, det_id) - 1 AS i, count(*) OVER (PARTITION BY source, tag_id) AS n FROM det JOIN k USING (source)),
p AS (SELECT q.* FROM q WHERE n <= k OR i IN (SELECT unnest(list_transform(range(q.k), lambda j: floor(j * (q.n - 1) / (q.k - 1))::BIGINT))))
SELECT source, median(side) AS tag_px, round(0.4 / median(side), 6) AS mm_per_px, count(*) AS n_quads FROM p GROUP BY source""")
def pixel_scale(spark, d):
    return _round(me.pixel_scale(views.track_detections(spark, d)), "mm_per_px")


_RUN_ATTRS = f"""SELECT source, key, number, word FROM (
  SELECT source, unnest([
    struct_pack(key := 'version', number := TRY_CAST('"{VERSION}"' AS DOUBLE), word := '"{VERSION}"'), struct_pack(key := 'stage', number := NULL, word := '"clean"'), struct_pack(key := 'cleaned_utc', number := NULL, word := 'null'),
    struct_pack(key := 'tag_size_px', number := 'inf'::DOUBLE, word := NULL), struct_pack(key := 'tag_size_multiplier', number := 2.0, word := NULL), struct_pack(key := 'max_move_px', number := max_move_px, word := NULL),
    struct_pack(key := 'box_fill_limit', number := 0.0, word := NULL), struct_pack(key := 'max_consecutive_misses', number := 10.0, word := NULL),
    struct_pack(key := 'box_filled_count', number := 0.0, word := NULL), struct_pack(key := 'box_pruned_count', number := 0.0, word := NULL), struct_pack(key := 'box_rechained_count', number := 0.0, word := NULL),
    struct_pack(key := 'rechain_affected_only', number := NULL, word := 'false'), struct_pack(key := 'recover_long_gaps', number := NULL, word := 'false'), struct_pack(key := 'min_gap_recovery_frames', number := 10.0, word := NULL),
    struct_pack(key := 'long_gap_recovered_count', number := 0.0, word := NULL), struct_pack(key := 'final_jump_pass', number := NULL, word := 'false'), struct_pack(key := 'final_jump_deleted_count', number := 0.0, word := NULL),
    struct_pack(key := 'tag_size_mm', number := 0.4, word := NULL), struct_pack(key := 'median_tag_side_px', number := tag_px, word := NULL), struct_pack(key := 'mm_per_px', number := mm_per_px, word := NULL), struct_pack(key := 'scale_sample_count', number := n_quads::DOUBLE, word := NULL),
    struct_pack(key := 'original_good_count', number := original_good_count::DOUBLE, word := NULL), struct_pack(key := 'final_count', number := final_count::DOUBLE, word := NULL)
  ], recursive := true) FROM ({ORACLES["quality_metrics"]}) JOIN ({ORACLES["pixel_scale"]}) USING (source))"""


@query(_RUN_ATTRS)
def run_attrs(spark, d):
    found = views.track_detections(spark, d)
    run = clean_to(f"{shared_folder(spark)}/run-{uuid.uuid4().hex}", found, None, PARAMS)
    counted = run.metrics.select("source", F.explode(F.create_map(*[x for c in ("original_good_count", "final_count") for x in (F.lit(c), F.col(c).cast("string"))])).alias("key", "value_json"))
    number = F.round(F.expr("try_cast(value_json AS DOUBLE)"), 6)
    return run.run_attrs.unionByName(counted).select("source", "key", number.alias("number"), F.when(number.isNull(), F.col("value_json")).alias("word"))


@query(f"WITH {_CLEAN} SELECT source, ass_type, count(*) AS n, count(CASE WHEN ass_type = 1 THEN side END) AS n_corners FROM fin GROUP BY source, ass_type")
def corner_provenance(spark, d):
    return clean_cells(views.track_detections(spark, d), None, PARAMS).groupBy("source", "ass_type").agg(F.count("*").alias("n"), F.count("c0x").alias("n_corners"))


@query(f"""WITH {_JUMP}, k AS (SELECT source, tag_id, pos, center_x, last_value(CASE WHEN center_x IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS a, last_value(CASE WHEN center_x IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS b FROM jump
  WINDOW p AS (PARTITION BY source, tag_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY source, tag_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, tag_id, a + 1 AS gap_start, b - 1 AS gap_end, count(*) AS length FROM k WHERE center_x IS NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY source, tag_id, a, b HAVING count(*) > 10""")
def long_gaps(spark, d):
    return tr.gap_runs(tr.drop_jumps(tr.step_distance(_filled(spark, d)), MAX_JUMP), 10)


def _jumped(spark, d):
    cells = tr.drop_jumps(tr.step_distance(_filled(spark, d)), MAX_JUMP)
    return mt.with_reach(cells, me.pixel_scale(views.track_detections(spark, d)), 2.0)


@query()
def chain_fill(spark, d):
    return mt.chain_fill(settle(ch.for_chains(_jumped(spark, d))), views.boxes(spark, d))


_HOP = """row_number() OVER (PARTITION BY {0} ORDER BY b.pos, sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y)), b.box_id) AS k
  FROM {1} a JOIN bx b ON a.source = b.source AND b.pos > a.pos AND b.pos <= a.pos + 10 JOIN sc ON sc.source = a.source WHERE sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y)) <= 2.0 * sc.tag_px"""
_FAR = "sqrt((a.center_x - b.center_x) * (a.center_x - b.center_x) + (a.center_y - b.center_y) * (a.center_y - b.center_y))"


@query(f"""WITH RECURSIVE {_JUMP}{_BOX[len(_OBS):]}, sc AS ({ORACLES["pixel_scale"]}),
bx AS (SELECT source, frame AS pos, box_id, center_x, center_y FROM box WHERE frame BETWEEN 0 AND {views.N_FRAMES - 1} AND source IN (SELECT source FROM jump)),
seen AS (SELECT source, tag_id, pos, center_x, center_y, lead(pos) OVER (PARTITION BY source, tag_id ORDER BY pos) AS stop FROM jump WHERE ass_type = 1),
hop AS (SELECT * FROM (SELECT a.source, a.box_id, b.box_id AS next_id, b.pos AS next_pos, {_FAR} AS d, {_HOP.format("a.source, a.box_id", "bx")}) WHERE k = 1),
start AS (SELECT * FROM (SELECT a.source, a.tag_id, a.pos AS gap, a.stop, b.box_id, b.pos, {_FAR} AS d, {_HOP.format("a.source, a.tag_id, a.pos", "seen")} AND (a.stop IS NULL OR b.pos < a.stop)) WHERE k = 1),
walk AS (SELECT source, tag_id, gap, stop, box_id, pos, d FROM start
  UNION ALL SELECT w.source, w.tag_id, w.gap, w.stop, hop.next_id, hop.next_pos, hop.d FROM walk w JOIN hop ON hop.source = w.source AND hop.box_id = w.box_id WHERE w.stop IS NULL OR hop.next_pos < w.stop),
shared AS (SELECT source, pos, box_id FROM walk GROUP BY ALL HAVING count(DISTINCT tag_id) > 1),
busy AS (SELECT DISTINCT source, tag_id, gap FROM walk SEMI JOIN shared USING (source, pos, box_id))
SELECT source, tag_id, pos, box_id, round(d, 6) AS distance FROM walk ANTI JOIN busy USING (source, tag_id, gap)""")
def chain_single(spark, d):
    alone = ch.single_walks(settle(ch.for_chains(_jumped(spark, d))), settle(views.boxes(spark, d)), "forward")
    return _round(alone.select("source", "tag_id", "pos", "box_id", "distance"), "distance")


@query()
def chain_walks(spark, d):
    return ch.chain_fill(settle(ch.for_chains(_jumped(spark, d))), settle(views.boxes(spark, d)))


@query(f"""WITH {_OBS} SELECT a.source, a.frame, a.obs_id AS det_id, b.obs_id AS box_id, round({_FAR}, 6) AS distance
FROM obs a JOIN obs b ON a.source = b.source AND a.frame = b.frame WHERE NOT a.is_box AND b.is_box AND {_FAR} <= 60""")
def near_boxes(spark, d):
    r = F.lit(60.0).alias("r")
    found = views.detections(spark, d).select("source", "frame", "det_id", "center_x", "center_y", r)
    met = near_pairs(found, views.boxes(spark, d).select("source", "frame", "box_id", "center_x", "center_y", r), ["source", "frame"], "r")
    return _round(met.select("source", "frame", "det_id", F.col("right_box_id").alias("box_id"), "distance"), "distance")


def _with_fills(spark, d):
    cells = settle(_jumped(spark, d).select(*TRACK, "frame", "pos", "center_x", "center_y", "ass_type", "reach"))
    boxes = settle(mt.placed_boxes(cells, views.boxes(spark, d).select("source", "frame", "box_id", "center_x", "center_y")))
    return cells, boxes, settle(mt.chain_fill(cells, boxes))


@query()
def ambiguity_prune(spark, d):
    cells, _, fills = _with_fills(spark, d)
    claims = mt.ambiguous_claims(fills)
    pruned, _ = mt.prune_ambiguous(mt.apply_fills(cells, fills, claims=claims), claims)
    return pruned.where("n_pruned = 1").select("source", "tag_id", "pos", "ass_type")


@query()
def rechain(spark, d):
    cells, boxes, fills = _with_fills(spark, d)
    claims = mt.ambiguous_claims(fills)
    pruned, bans = mt.prune_ambiguous(mt.apply_fills(cells, fills, claims=claims), claims)
    return mt.rechain(settle(pruned.drop("allowed", "n_pruned")), mt.ban_boxes(boxes, bans))


@query()
def long_gap_recovery(spark, d):
    return ch.recover_long_gaps(settle(ch.for_recovery(_jumped(spark, d))), views.boxes(spark, d))


@query()
def clean_full(spark, d):
    full = CleanParams(**(PARAMS.__dict__ | {"recover_long_gaps": True, "final_jump_pass": True}))
    cells, _ = clean(views.track_detections(spark, d), views.boxes(spark, d), full)
    return cells.select("source", "tag_id", "frame", "ass_type", "center_x", "center_y", "distance")


@query(f"WITH {_BOX} SELECT source, count(*) AS n, sum(box_id)::BIGINT AS ids FROM box GROUP BY source")
def undecoded_boxes(spark, d):
    return bx.undecoded(views.boxes(spark, d)).groupBy("source").agg(F.count("*").alias("n"), F.sum("box_id").alias("ids"))


@query(f"WITH {_BOX} SELECT source, frame, box_id, round(confidence, 6) AS confidence FROM box WHERE confidence >= 0.4")
def confidence_filter(spark, d):
    return _round(bx.confident(views.boxes(spark, d), 0.4).select("source", "frame", "box_id", "confidence"), "confidence")


_LAYOUT = _BOX + f""",
cap AS (SELECT *, round_even({PAD} * median(box_x2 - box_x1) OVER w, 0)::INT AS cx, round_even({PAD} * median(box_y2 - box_y1) OVER w, 0)::INT AS cy,
               trunc(box_x1)::INT AS ix1, trunc(box_x2)::INT AS ix2, trunc(box_y1)::INT AS iy1, trunc(box_y2)::INT AS iy2 FROM box WINDOW w AS (PARTITION BY source, frame)),
pad AS (SELECT *, least(round_even({PAD} * (ix2 - ix1), 0)::INT, cx) AS px, least(round_even({PAD} * (iy2 - iy1), 0)::INT, cy) AS py FROM cap),
lay0 AS (SELECT *, greatest(ix1 - px, 0) AS crop_x1, least(ix2 + px, {FRAME_W}) AS crop_x2, greatest(iy1 - py, 0) AS crop_y1, least(iy2 + py, {FRAME_H}) AS crop_y2 FROM pad),
lay AS (SELECT *, coalesce(sum(crop_x2 - crop_x1) OVER (PARTITION BY source, frame ORDER BY box_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS strip_x FROM lay0)"""


def _layout(spark, d):
    return bx.crop_layout(views.boxes(spark, d), FRAME_W, FRAME_H, PAD)


@query(f"WITH {_LAYOUT} SELECT source, frame, box_id, crop_x1, crop_x2, crop_y1, crop_y2, strip_x FROM lay")
def crop_layout(spark, d):
    return _layout(spark, d).select("source", "frame", "box_id", "crop_x1", "crop_x2", "crop_y1", "crop_y2", "strip_x")


@query(f"WITH {_LAYOUT} SELECT source, frame, max(crop_y2 - crop_y1) AS strip_height, sum(crop_x2 - crop_x1)::INT AS strip_width FROM lay GROUP BY source, frame")
def strip_sizes(spark, d):
    return bx.strips(_layout(spark, d))


# Synthetic decodes: each box's own centre in its strip, shifted by the tag of the line.
_DECODES = _LAYOUT + """,
dec AS (SELECT source, frame, box_id AS decode_idx, box_id % 300 AS tag_id, (strip_x + center_x - crop_x1 + (box_id % 7 - 3) * 3)::DOUBLE AS cx, (center_y - crop_y1 + box_id % 5)::DOUBLE AS cy FROM lay),
hit AS (SELECT dec.source, dec.frame, decode_idx, dec.tag_id, lay.box_id, box_x1, box_y1, box_x2, box_y2, dec.cx + crop_x1 - strip_x AS center_x, dec.cy + crop_y1 AS center_y
        FROM dec JOIN lay ON dec.source = lay.source AND dec.frame = lay.frame AND dec.cx < strip_x + crop_x2 - crop_x1 AND (dec.cx >= strip_x OR strip_x = 0))"""


def _decodes(layout):
    i = F.col("box_id")
    return layout.select("source", "frame", i.alias("decode_idx"), (i % 300).alias("tag_id"), (F.col("strip_x") + F.col("center_x") - F.col("crop_x1") + (i % 7 - 3) * 3).cast("double").alias("cx"), (F.col("center_y") - F.col("crop_y1") + i % 5).cast("double").alias("cy"))


def _found(spark, d):
    layout = _layout(spark, d)
    return bx.decodes_to_boxes(_decodes(layout), layout)


@query(f"WITH {_DECODES} SELECT source, frame, decode_idx, tag_id, box_id, round(center_x, 6) AS center_x, round(center_y, 6) AS center_y FROM hit")
def reproject_tags(spark, d):
    return _round(_found(spark, d).select("source", "frame", "decode_idx", "tag_id", "box_id", "center_x", "center_y"), "center_x", "center_y")


@query(f"""WITH {_DECODES} SELECT source, frame, decode_idx, box_id FROM hit WHERE tag_id <= 237 AND tag_id NOT IN (7, 8)
 AND (center_x - (box_x1 + box_x2) / 2) * (center_x - (box_x1 + box_x2) / 2) + (center_y - (box_y1 + box_y2) / 2) * (center_y - (box_y1 + box_y2) / 2) <= (0.6 * least(box_x2 - box_x1, box_y2 - box_y1)) * (0.6 * least(box_x2 - box_x1, box_y2 - box_y1))""")
def offset_filter(spark, d):
    return bx.near_box_center(bx.valid_ids(_found(spark, d), 237, (7, 8)), 0.6).select("source", "frame", "decode_idx", "box_id")


@query(f"""WITH {_DECODES}, l AS (SELECT source, frame, box_id, max_by(tag_id, decode_idx) AS t FROM hit GROUP BY source, frame, box_id)
SELECT source, frame, box_id, t IS NOT NULL AS decoded, coalesce(t, -1) AS tag_id FROM box LEFT JOIN l USING (source, frame, box_id)""")
def all_boxes(spark, d):
    return bx.all_boxes(views.boxes(spark, d), _found(spark, d)).select("source", "frame", "box_id", "decoded", "tag_id")


@query(f"""WITH {_DECODES}, m AS (SELECT DISTINCT source, frame, box_id FROM hit WHERE tag_id <= 150),
q AS (SELECT source, frame, decode_idx AS quad_id, box_id, count(*) OVER (PARTITION BY source, frame, box_id) AS n FROM hit WHERE tag_id > 150)
SELECT source, frame, quad_id, box_id FROM q ANTI JOIN m USING (source, frame, box_id) WHERE n = 1""")
def quad_recovery(spark, d):
    found = _found(spark, d)
    decoded = bx.all_boxes(views.boxes(spark, d), found.where("tag_id <= 150"))
    quads = found.where("tag_id > 150").withColumnRenamed("decode_idx", "quad_id").select("source", "frame", "quad_id", "box_id")
    return bx.lone_quads(quads, decoded)


_OVERLAP = "(least(b.x2, o.x2) - greatest(b.x1, o.x1)) * (least(b.y2, o.y2) - greatest(b.y1, o.y1))"


@query(f"""WITH RECURSIVE {_BOX}, o AS (SELECT source, (frame // 50)::BIGINT AS frame, box_id, box_x1 AS x1, box_y1 AS y1, box_x2 AS x2, box_y2 AS y2, confidence, row_number() OVER (PARTITION BY source, frame // 50 ORDER BY confidence DESC, box_id) AS k FROM box),
r AS (SELECT source, frame, 0::BIGINT AS k, []::STRUCT(box_id BIGINT, confidence DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)[] AS kept FROM (SELECT DISTINCT source, frame FROM o)
  UNION ALL SELECT r.source, r.frame, r.k + 1, CASE WHEN len(list_filter(r.kept, lambda b: least(b.x2, o.x2) > greatest(b.x1, o.x1) AND least(b.y2, o.y2) > greatest(b.y1, o.y1)
      AND {_OVERLAP} > 0.4 * ((b.x2 - b.x1) * (b.y2 - b.y1) + (o.x2 - o.x1) * (o.y2 - o.y1) - {_OVERLAP}))) > 0 THEN r.kept
    ELSE list_append(r.kept, struct_pack(box_id := o.box_id, confidence := o.confidence::DOUBLE, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)) END
  FROM r JOIN o ON o.source = r.source AND o.frame = r.frame AND o.k = r.k + 1),
e AS (SELECT source, frame, unnest(kept[:300]) AS b FROM (SELECT *, row_number() OVER (PARTITION BY source, frame ORDER BY k DESC) AS z FROM r) WHERE z = 1)
SELECT source, frame, b.box_id AS box_id, round(b.confidence, 6) AS confidence FROM e""")
def nms(spark, d):
    crowded = views.boxes(spark, d).withColumn("frame", F.expr("frame DIV 50")).withColumn("class_id", F.lit(0))
    return _round(bx.suppress(crowded, 0.4).select("source", "frame", "box_id", "confidence"), "confidence")


@query(f"WITH {_BOX} SELECT source, frame, count(*) AS n_boxes FROM box GROUP BY source, frame")
def boxes_per_frame(spark, d):
    return me.counts_per_frame(views.boxes(spark, d))


# Quads: squares bent by the line number.
_QUAD = _OBS + """,
quad AS (SELECT source, frame, obs_id AS quad_id, center_x, center_y, center_x AS c0x, center_y + side AS c0y, center_x + side AS c1x, center_y + side + obs_id % 4 AS c1y, center_x + side + obs_id % 3 AS c2x, center_y AS c2y, center_x AS c3x, center_y AS c3y FROM obs WHERE is_box),
sd AS (SELECT *, sqrt((c1x-c0x)*(c1x-c0x)+(c1y-c0y)*(c1y-c0y)) AS s0, sqrt((c2x-c1x)*(c2x-c1x)+(c2y-c1y)*(c2y-c1y)) AS s1, sqrt((c3x-c2x)*(c3x-c2x)+(c3y-c2y)*(c3y-c2y)) AS s2, sqrt((c0x-c3x)*(c0x-c3x)+(c0y-c3y)*(c0y-c3y)) AS s3,
       abs(c0x*c1y-c1x*c0y + c1x*c2y-c2x*c1y + c2x*c3y-c3x*c2y + c3x*c0y-c0x*c3y) / 2 AS area FROM quad),
an AS (SELECT *, degrees(acos(greatest(least(((c3x-c0x)*(c1x-c0x)+(c3y-c0y)*(c1y-c0y))/(s3*s0), 1.0), -1.0))) AS a0, degrees(acos(greatest(least(((c0x-c1x)*(c2x-c1x)+(c0y-c1y)*(c2y-c1y))/(s0*s1), 1.0), -1.0))) AS a1,
       degrees(acos(greatest(least(((c1x-c2x)*(c3x-c2x)+(c1y-c2y)*(c3y-c2y))/(s1*s2), 1.0), -1.0))) AS a2, degrees(acos(greatest(least(((c2x-c3x)*(c0x-c3x)+(c2y-c3y)*(c0y-c3y))/(s2*s3), 1.0), -1.0))) AS a3 FROM sd),
ms AS (SELECT source, frame, quad_id, center_x, center_y, area, least(a0,a1,a2,a3) AS angle_min, greatest(a0,a1,a2,a3) AS angle_max, least(s0,s1,s2,s3) AS side_min, greatest(s0,s1,s2,s3) AS side_max, least(s0,s1,s2,s3)/greatest(s0,s1,s2,s3) AS ratio FROM an)"""
_LIMITS = {"area_min": 205.0, "area_max": 300.0, "angle_min": 70.0, "angle_max": 110.0, "side_min": 14.0, "side_max": 19.0, "ratio_min": 0.8, "dedup_px": 10.0}


def _quads(spark, d):
    o = views.observations(spark, d).where("is_box")
    x, y, s, i = F.col("center_x"), F.col("center_y"), F.col("side"), F.col("obs_id")
    corners = {"c0x": x, "c0y": y + s, "c1x": x + s, "c1y": y + s + i % 4, "c2x": x + s + i % 3, "c2y": y, "c3x": x, "c3y": y}
    return o.withColumns(corners).select("source", "frame", i.alias("quad_id"), "center_x", "center_y", *corners)


_MEASURES = ("area", "angle_min", "angle_max", "side_min", "side_max", "ratio")


@query(f"WITH {_QUAD} SELECT source, frame, quad_id, {', '.join(f'round({c}, 6) AS {c}' for c in _MEASURES)} FROM ms")
def polygon_geometry(spark, d):
    return _round(qu.measured(_quads(spark, d)).select("source", "frame", "quad_id", *_MEASURES), *_MEASURES)


@query(f"""WITH {_QUAD}, e AS (SELECT unnest([a0, a1, a2, a3]) AS a, unnest([s0, s1, s2, s3]) AS s FROM an)
SELECT (SELECT round(quantile_cont(area, 0.01), 6) FROM an) AS area_min, (SELECT round(quantile_cont(area, 0.99), 6) FROM an) AS area_max, round(quantile_cont(a, 0.01), 6) AS angle_min, round(quantile_cont(a, 0.99), 6) AS angle_max,
       round(quantile_cont(s, 0.001), 6) AS side_min, round(quantile_cont(s, 0.999), 6) AS side_max, 0.6::DOUBLE AS ratio_min, 10.0::DOUBLE AS dedup_px FROM e""")
def threshold_seeding(spark, d):
    return _round(qu.seed_thresholds(_quads(spark, d)), "area_min", "area_max", "angle_min", "angle_max", "side_min", "side_max")


_VERDICT = _QUAD + ", dt AS (SELECT source, frame, center_x, center_y FROM obs WHERE NOT is_box)" + """,
nr AS (SELECT ms.source, ms.frame, quad_id, min(sqrt((ms.center_x - dt.center_x) * (ms.center_x - dt.center_x) + (ms.center_y - dt.center_y) * (ms.center_y - dt.center_y))) AS nearest FROM ms JOIN dt USING (source, frame) GROUP BY ALL),
vd AS (SELECT ms.*, CASE WHEN NOT area BETWEEN {area_min} AND {area_max} THEN 'area' WHEN NOT (angle_min >= {angle_min} AND angle_max <= {angle_max}) THEN 'angle'
  WHEN NOT (side_min >= {side_min} AND side_max <= {side_max}) OR ratio < {ratio_min} THEN 'side' WHEN coalesce(nearest < {dedup_px}, false) THEN 'dedup' ELSE 'ok' END AS verdict
  FROM ms LEFT JOIN nr USING (source, frame, quad_id))""".format(**_LIMITS)


def _verdicts(spark, d):
    near = qu.nearest_valid(qu.measured(_quads(spark, d)), views.detections(spark, d))
    return qu.classify(near, _LIMITS)


@query(f"WITH {_VERDICT} SELECT source, frame, quad_id, verdict FROM vd")
def quad_classify(spark, d):
    return _verdicts(spark, d).select("source", "frame", "quad_id", "verdict")


@query(f"WITH {_VERDICT} SELECT source, frame, quad_id, CASE WHEN quad_id % 11 = 0 THEN false WHEN quad_id % 7 = 0 THEN true ELSE verdict = 'ok' END AS kept FROM vd")
def override_resolution(spark, d):
    q = _verdicts(spark, d)
    choice = F.when(F.col("quad_id") % 11 == 0, "exclude").when(F.col("quad_id") % 7 == 0, "include")
    given = _quads(spark, d).select("source", "frame", "quad_id", choice.alias("choice")).where("choice IS NOT NULL")
    return qu.decided(q, given).select("source", "frame", "quad_id", "kept")


@query(f"WITH {_QUAD} SELECT source, quad_id, format('0' || repeat(' {{:.6f}}', 8), c0x/{FRAME_W}.0, c0y/{FRAME_H}.0, c1x/{FRAME_W}.0, c1y/{FRAME_H}.0, c2x/{FRAME_W}.0, c2y/{FRAME_H}.0, c3x/{FRAME_W}.0, c3y/{FRAME_H}.0) AS line FROM quad")
def obb_export(spark, d):
    return _quads(spark, d).select("source", "quad_id", g.obb_line(F.lit(0), g.CORNERS, F.lit(float(FRAME_W)), F.lit(float(FRAME_H))).alias("line"))


@query(f"""WITH {_QUAD}, fr AS (SELECT DISTINCT frame FROM quad WHERE frame >= 0 AND frame % 3 <> 0),
pic AS (SELECT source, frame, source || '_' || lpad(frame::VARCHAR, 6, '0') AS name, CASE WHEN frame % 5 = 0 THEN 'val' ELSE 'train' END AS part FROM (SELECT DISTINCT source FROM quad) s, fr),
kq AS (SELECT quad.*, format('0' || repeat(' {{:.6f}}', 8), c0x/{FRAME_W}.0, c0y/{FRAME_H}.0, c1x/{FRAME_W}.0, c1y/{FRAME_H}.0, c2x/{FRAME_W}.0, c2y/{FRAME_H}.0, c3x/{FRAME_W}.0, c3y/{FRAME_H}.0) AS line
  FROM quad JOIN ms USING (source, frame, quad_id)
  WHERE CASE WHEN quad_id % 11 = 0 THEN false WHEN quad_id % 7 = 0 THEN true ELSE area BETWEEN {_LIMITS["area_min"]} AND {_LIMITS["area_max"]} AND angle_min >= {_LIMITS["angle_min"]} AND angle_max <= {_LIMITS["angle_max"]}
    AND side_min >= {_LIMITS["side_min"]} AND side_max <= {_LIMITS["side_max"]} AND ratio >= {_LIMITS["ratio_min"]} END)
SELECT part || '/labels/' || name || '.txt' AS file, coalesce(string_agg(line, chr(10) ORDER BY quad_id), '') || chr(10) AS content FROM pic LEFT JOIN kq USING (source, frame) GROUP BY ALL""")
def review_labels(spark, d):
    quads, i = _quads(spark, d), F.col("quad_id")
    choice = F.when(i % 11 == 0, "exclude").when(i % 7 == 0, "include")
    seen = quads.where("frame >= 0").select("frame", F.when(choice.isNotNull(), F.struct(i.cast("string").alias("k"), choice.alias("v"))).alias("o")).distinct()
    per = seen.groupBy("frame").agg(F.map_from_entries(F.collect_list("o")).alias("overrides"))
    frame = F.struct(F.col("frame").cast("string").alias("k"), F.struct(F.when(F.col("frame") % 3 == 0, "rejected").otherwise("accepted").alias("status"), "overrides").alias("v"))
    sessions = per.groupBy(F.expr("frame DIV 500")).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(frame)).alias("frames"))).alias("value")).select("value")
    candidates = quads.withColumnRenamed("source", "experiment")
    experiments = candidates.select("experiment", F.lit(FRAME_W).alias("width"), F.lit(FRAME_H).alias("height")).distinct()
    by_frame = lambda pictures: pictures.withColumn("part", F.when(F.col("frame") % 5 == 0, "val").otherwise("train"))
    files = review.review_export(candidates, experiments, review.decisions(sessions), _LIMITS, by_frame)
    return files.select("file", F.col("content").cast("string").alias("content"))


@query("SELECT DISTINCT s_suppkey, unnest(list_append(range(s_suppkey % 10, s_suppkey % 10 + s_nationkey % 4 + 1), 20 + s_nationkey))::INT AS idx FROM supplier WHERE s_suppkey % 9 <> 0")
def index_specs(spark, d):
    tables.register(spark)
    low, n = F.col("s_suppkey") % 10, F.col("s_nationkey")
    spec = F.when(F.col("s_suppkey") % 9 != 0, F.concat_ws("", low.cast("string"), F.lit("-"), (low + n % 4).cast("string"), F.lit(", "), (20 + n).cast("string")))
    specs = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", spec.alias("spec"))
    return spark.sql("SELECT s_suppkey, idx FROM {specs} s, LATERAL index_spec(s.spec) i", specs=specs)


@query("""SELECT p_partkey, unnest(['brand', 'size', 'nested.price', 'nested.small']) AS key, unnest([NULL, p_size::DOUBLE, p_retailprice::DOUBLE, NULL]) AS number,
       unnest([p_brand, NULL, NULL, CASE WHEN p_size < 20 THEN 'true' ELSE 'false' END]) AS word FROM part""")
def preset_entries(spark, d):
    tables.register(spark)
    nested = F.struct(F.col("p_retailprice").cast("double").alias("price"), (F.col("p_size") < 20).alias("small"))
    presets = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), nested.alias("nested"))).alias("preset"))
    return spark.sql("SELECT p_partkey, key, number, word FROM {presets} p, LATERAL preset_entries(p.preset) e", presets=presets)


_VISIBLE = _GRID + """,
vis AS (SELECT source, frame, count(center_x) AS n_visible FROM s0 GROUP BY source, frame), nt AS (SELECT source, count(DISTINCT tag_id) AS n_tags FROM s0 GROUP BY source)"""


def _visible(spark, d):
    s = _stamped(spark, d)
    return me.visible_tags(s), s.groupBy("source").agg(F.countDistinct("tag_id").alias("n_tags"))


@query(f"WITH {_VISIBLE} SELECT * FROM vis")
def visible_per_frame(spark, d):
    return _visible(spark, d)[0]


def _strided(src: str, order: str, n: int) -> str:
    return f"(SELECT source, frame, n_visible FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {order}) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM {src}) WHERE k % greatest(1, n // {n}) = 0 AND k // greatest(1, n // {n}) < {n})"


_TOP = _VISIBLE + """,
p0 AS (SELECT *, n_visible >= floor(n_tags * 0.8) AS good FROM vis JOIN nt USING (source)),
p1 AS (SELECT *, sum(good::INT) OVER (PARTITION BY source) >= {0} AS enough FROM p0),
p2 AS (SELECT source, frame, n_visible FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_visible DESC, frame) AS k FROM p1 WHERE good OR NOT enough) WHERE k <= 1000)"""


@query(f"WITH {_TOP.format(SAMPLE)} SELECT * FROM {_strided('p2', 'n_visible DESC, frame', SAMPLE)}")
def frames_top(spark, d):
    return sa.top_frames(*_visible(spark, d), SAMPLE)


@query(f"WITH {_VISIBLE} SELECT * FROM {_strided('vis', 'frame', SAMPLE)}")
def frames_uniform(spark, d):
    return sa.uniform_frames(_visible(spark, d)[0], SAMPLE)


@query(f"WITH {_TOP.format(SAMPLE // 2)}, tp AS {_strided('p2', 'n_visible DESC, frame', SAMPLE // 2)}, rs AS (SELECT vis.* FROM vis ANTI JOIN tp USING (source, frame)) SELECT * FROM tp UNION ALL SELECT * FROM {_strided('rs', 'frame', SAMPLE - SAMPLE // 2)}")
def frames_mixed(spark, d):
    return sa.mixed_frames(*_visible(spark, d), SAMPLE)


@query(f"""WITH {_BOX}, bc AS (SELECT source, frame, count(*) AS n_visible FROM box GROUP BY source, frame),
p2 AS (SELECT source, frame, n_visible FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_visible DESC, frame) AS k FROM bc) WHERE k <= 200),
tp AS {_strided('p2', 'n_visible DESC, frame', SAMPLE // 2)}, rs AS (SELECT bc.* FROM bc ANTI JOIN tp USING (source, frame))
SELECT source, frame, n_visible AS n_boxes FROM (SELECT * FROM tp UNION ALL SELECT * FROM {_strided('rs', 'frame', SAMPLE - SAMPLE // 2)})""")
def frames_by_boxes(spark, d):
    return sa.frames_by_boxes(me.counts_per_frame(views.boxes(spark, d)), SAMPLE, 200)


@query(f"""WITH {_DET}, f AS (SELECT *, frame - lag(frame) OVER (PARTITION BY source ORDER BY frame) AS step FROM (SELECT DISTINCT source, frame FROM det))
SELECT source, frame, step IS NULL OR step > 2 AS seek, CASE WHEN step IS NULL OR step > 2 THEN 1 ELSE step END::INT AS n_reads FROM f""")
def read_plan(spark, d):
    return sa.read_plan(views.detections(spark, d).select("source", "frame"), 2)


@query(f"""WITH {_GRID}, e AS (SELECT source, tag_id, ass_type, last_value(CASE WHEN ass_type = 1 THEN pos END IGNORE NULLS) OVER p AS a, last_value(CASE WHEN ass_type = 1 THEN pos END IGNORE NULLS) OVER n AS b FROM s0
  WINDOW p AS (PARTITION BY source, tag_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), n AS (PARTITION BY source, tag_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source, tag_id, count(a) AS n_prev, sum(a)::BIGINT AS sum_prev, count(b) AS n_next, sum(b)::BIGINT AS sum_next FROM e WHERE ass_type <> 1 GROUP BY source, tag_id""")
def enclosing_originals(spark, d):
    e = tr.enclosing_originals(_stamped(spark, d)).where("ass_type <> 1")
    return e.groupBy("source", "tag_id").agg(*[f(c).alias(f"{n}_{k}") for k, c in (("prev", "prev_original"), ("next", "next_original")) for n, f in (("n", F.count), ("sum", F.sum))])


@query(f"""WITH {_VISIBLE} SELECT source, frame FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_visible DESC, frame) AS k FROM vis) WHERE k <= 13
UNION SELECT source, frame FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_visible, frame) AS k FROM vis WHERE n_visible > 0) WHERE k <= 27""")
def best_worst(spark, d):
    return sa.best_worst(_visible(spark, d)[0], 40, 1 / 3)


@query(f"WITH {_DET}, n AS (SELECT source, max(frame) + 1 AS n FROM det GROUP BY source) SELECT source, f.f::INT AS frame FROM n, range({views.N_FRAMES}) f(f) WHERE f.f < n AND f.f % greatest(1, n // {SAMPLE}) = 0 AND f.f / greatest(1, n // {SAMPLE}) < {SAMPLE}")
def stride_select(spark, d):
    n = views.detections(spark, d).groupBy("source").agg((F.max("frame") + 1).alias("n_frames"))
    return sa.stride_frames(n, SAMPLE)


_TRUTH = _LAYOUT + """,
dd AS (SELECT source, frame, tag_id, 1 AS ass_type, center_x, center_y FROM obs WHERE NOT is_box),
gt AS (SELECT lay.source, lay.frame, box_id AS crop_idx, dd.tag_id, CASE WHEN box_id % 4 = 0 THEN 2 ELSE ass_type END AS ass_type FROM lay JOIN dd ON lay.source = dd.source AND lay.frame = dd.frame AND dd.center_x BETWEEN crop_x1 AND crop_x2 AND dd.center_y BETWEEN crop_y1 AND crop_y2)"""


def _crops(spark, d):
    return _layout(spark, d).withColumnRenamed("box_id", "crop_idx").select("source", "frame", "crop_idx", "crop_x1", "crop_x2", "crop_y1", "crop_y2")


def _truth(spark, d):
    t = ev.truth_in_crops(views.detections(spark, d).withColumn("ass_type", F.lit(1)), _crops(spark, d))
    return t.withColumn("ass_type", F.when(F.col("crop_idx") % 4 == 0, 2).otherwise(F.col("ass_type")))


@query(f"WITH {_TRUTH} SELECT * FROM gt")
def gt_in_crop(spark, d):
    return _truth(spark, d)


@query(f"WITH {_TRUTH} SELECT tag_id, count(*) AS n_total, count(*) FILTER (ass_type = 1) AS n_original, round(1.0 - count(*) FILTER (ass_type = 1) / count(*), 6) AS difficulty FROM gt GROUP BY tag_id")
def id_difficulty(spark, d):
    return _round(ev.id_difficulty(_truth(spark, d)), "difficulty")


# Decodes for scoring: detections shifted by up to 3 px.
_SCORED = _TRUTH + """,
de AS (SELECT source, frame, obs_id AS decode_idx, tag_id, center_x + obs_id % 4 AS center_x, center_y FROM obs WHERE NOT is_box),
dc AS (SELECT de.source, de.frame, decode_idx, de.tag_id, min(box_id) AS crop_idx FROM de JOIN lay ON de.source = lay.source AND de.frame = lay.frame AND de.center_x >= crop_x1 AND de.center_x < crop_x2 AND de.center_y >= crop_y1 AND de.center_y < crop_y2 GROUP BY ALL)"""


def _scored(spark, d):
    de = views.detections(spark, d).select("source", "frame", F.col("det_id").alias("decode_idx"), "tag_id", (F.col("center_x") + F.col("det_id") % 4).alias("center_x"), "center_y")
    return ev.decodes_in_crops(de, _crops(spark, d))


@query(f"WITH {_SCORED} SELECT * FROM dc")
def decode_to_crop(spark, d):
    return _scored(spark, d)


@query(f"""WITH {_SCORED}, t AS (SELECT DISTINCT source, frame, crop_idx, tag_id FROM gt), q AS (SELECT DISTINCT source, frame, crop_idx, tag_id FROM dc),
j AS (SELECT coalesce(t.source, q.source) AS source, t.tag_id AS a, q.tag_id AS b FROM t FULL JOIN q ON t.source = q.source AND t.frame = q.frame AND t.crop_idx = q.crop_idx AND t.tag_id = q.tag_id)
SELECT source, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS missed FROM j GROUP BY source""")
def eval_recall(spark, d):
    return ev.recall_table(ev.crop_results(_truth(spark, d), _scored(spark, d))).select("source", "tp", "fp", "missed")


@query(f"""WITH {_SCORED}, k AS (SELECT source, frame, crop_idx, count(DISTINCT tag_id) AS k FROM dc GROUP BY ALL)
SELECT lay.source, count(*) AS n_crops, count(*) FILTER (k >= 1) AS n_hits, count(*) FILTER (k > 1) AS n_multi FROM lay LEFT JOIN k ON k.source = lay.source AND k.frame = lay.frame AND k.crop_idx = lay.box_id GROUP BY lay.source""")
def eval_yield(spark, d):
    return ev.yield_table(_crops(spark, d), _scored(spark, d))


@query(f"WITH {_DET} SELECT source, frame, count(*) AS n_decodes, count(DISTINCT tag_id) AS n_distinct, count(*) - count(DISTINCT tag_id) AS n_duplicates FROM det GROUP BY source, frame")
def image_counts(spark, d):
    return ev.image_counts(views.detections(spark, d))


@query(f"""WITH RECURSIVE {_TRUTH}, hd AS (SELECT tag_id, 1 + 2 * (1.0::DOUBLE - count(*) FILTER (ass_type = 1) / count(*)) AS hard FROM gt GROUP BY tag_id),
cg AS (SELECT source, frame, tag_id::BIGINT AS tag_id, hard, list(tag_id::BIGINT) OVER (PARTITION BY source, frame) AS ids FROM (SELECT DISTINCT source, frame, tag_id FROM gt) JOIN hd USING (tag_id)),
st AS (SELECT 0 AS k, '' AS source, 0 AS frame, []::VARCHAR[] AS chosen, []::BIGINT[] AS seen
  UNION ALL SELECT k + 1, source, frame, list_append(chosen, source || '/' || frame), list_concat(seen, ids) FROM (
    SELECT k, source, frame, any_value(chosen) AS chosen, any_value(seen) AS seen, any_value(ids) AS ids,
           row_number() OVER (ORDER BY round(sum(hard * CASE WHEN times >= 3 THEN 1 / (times + 1) WHEN times = 0 THEN 30.0 ELSE 10.0 END), 9) DESC, source, frame) AS r
    FROM (SELECT st.k, cg.source, cg.frame, st.chosen, st.seen, cg.ids, cg.hard, len(list_filter(st.seen, lambda x: x = cg.tag_id)) AS times FROM st JOIN cg ON NOT list_contains(st.chosen, cg.source || '/' || cg.frame) WHERE st.k < 20)
    GROUP BY k, source, frame) WHERE r = 1)
SELECT source, frame, k AS place FROM st WHERE k > 0""")
def set_cover(spark, d):
    chosen = ev.cover(_truth(spark, d), 20, 3)
    return spark.createDataFrame([(s, f, k + 1) for k, (s, f) in enumerate(chosen)], "source string, frame int, place int")


_RECORDS = _OBS + """,
rc AS (SELECT y::VARCHAR AS experiment, frame, obs_id AS crop_idx, tag_id, (1 + l_linenumber % 3)::INT AS ass_type, source FROM obs)"""


@query(f"WITH {_RECORDS}, n AS (SELECT count(DISTINCT experiment) AS n FROM rc), h AS (SELECT experiment, row_number() OVER (ORDER BY experiment DESC) AS k FROM (SELECT DISTINCT experiment FROM rc)) SELECT experiment, CASE WHEN n >= 2 AND k <= least(n - 1, greatest(1, round_even(0.2 * n, 0))) THEN 'val' ELSE 'train' END AS part, count(*) AS n FROM rc JOIN h USING (experiment), n GROUP BY ALL".replace("AS n FROM rc JOIN", "AS n_records FROM rc JOIN"))
def experiment_split(spark, d):
    return sa.experiment_split(views.crop_records(spark, d), 0.2).groupBy("experiment", "part").agg(F.count("*").alias("n_records"))


@query(f"WITH {_RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY experiment, frame, crop_idx) AS k, count(*) OVER (PARTITION BY tag_id) AS n FROM rc) SELECT tag_id, crop_idx, CASE WHEN k > n - least(n - 1, greatest(1, round_even(0.2 * n, 0))) THEN 'val' ELSE 'train' END AS part FROM k")
def tail_split(spark, d):
    return sa.tail_split(views.crop_records(spark, d), 0.2).select("tag_id", "crop_idx", "part")


@query(f"WITH {_RECORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY tag_id ORDER BY experiment, frame, crop_idx) - 1 AS k, count(*) OVER (PARTITION BY tag_id) AS n FROM rc) SELECT tag_id, crop_idx FROM k WHERE n <= 50 OR k IN (SELECT unnest(list_transform(range(50), lambda i: round_even(i * (k.n - 1) / 49.0, 0)::BIGINT)))")
def stride_cap(spark, d):
    return sa.stride_cap(views.crop_records(spark, d), 50).select("tag_id", "crop_idx")


@query(f"WITH {_RECORDS} SELECT 'all' AS part, tag_id, ass_type, count(*) AS n FROM rc GROUP BY ALL")
def class_counts(spark, d):
    return sa.class_counts(views.crop_records(spark, d).withColumn("part", F.lit("all")))


_ATTRS = _DET + """,
att AS (SELECT source, 'n_tags' AS key, count(DISTINCT tag_id)::VARCHAR AS value FROM det GROUP BY source UNION ALL SELECT source, 'first_frame', min(frame)::VARCHAR FROM det GROUP BY source UNION ALL SELECT source, 'n_detections', count(*)::VARCHAR FROM det GROUP BY source)"""


@query(f"WITH {_ATTRS}, l AS (SELECT key, list(value ORDER BY source) AS v, count(DISTINCT value) AS n FROM att GROUP BY key) SELECT key, CASE WHEN n = 1 THEN v[1] END AS value, CASE WHEN n > 1 THEN array_to_string(v, ',') END AS listed, n > 1 AS varies FROM l")
def merge_attrs(spark, d):
    a = views.detections(spark, d).groupBy("source").agg(F.countDistinct("tag_id").cast("string").alias("n_tags"), F.min("frame").cast("string").alias("first_frame"), F.count("*").cast("string").alias("n_detections"))
    long = a.unpivot("source", ["n_tags", "first_frame", "n_detections"], "key", "value")
    return rec.merge_attributes(long).select("key", "value", F.array_join("values", ",").alias("listed"), "varies")


@query(f"WITH {_DET}, f AS (SELECT DISTINCT source, frame FROM det) SELECT row_number() OVER (ORDER BY source, frame) - 1 AS global_frame, source, frame AS video_frame FROM f")
def global_frame_index(spark, d):
    return rec.global_frames(views.detections(spark, d).select("source", "frame").distinct()).select(F.col("global_frame").cast("long").alias("global_frame"), "source", "video_frame")


@query(f"WITH {_DET}, s AS (SELECT source, 0.4 / avg(side) AS mm FROM det GROUP BY source) SELECT round(median(mm), 6) AS mm_per_px FROM s")
def median_scale(spark, d):
    o = views.observations(spark, d).where(~F.col("is_box")).groupBy("source").agg((0.4 / F.avg("side")).alias("mm_per_px"))
    return _round(rec.median_scale(o), "mm_per_px")


@query(f"WITH {_GRID}, t AS (SELECT source, tag_id, pos, count(center_x) OVER w AS n_points, round(sum(center_x) OVER w, 6) AS sum_x FROM s0 WINDOW w AS (PARTITION BY source, tag_id ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 4 PRECEDING)) SELECT source, tag_id, pos, n_points, coalesce(sum_x, 0.0) AS sum_x FROM t WHERE pos > 54")
def trail_points(spark, d):
    t = rec.trails(_stamped(spark, d)).where("trail IS NOT NULL")
    total = F.aggregate("trail", F.lit(0.0), lambda a, p: a + p["center_x"])
    return t.select("source", "tag_id", "pos", F.size("trail").cast("long").alias("n_points"), F.round(total, 6).alias("sum_x"))


_TRAIL = "count(center_x) OVER (PARTITION BY source, tag_id ORDER BY pos ROWS BETWEEN {0} PRECEDING AND {1} PRECEDING)"


@query(f"""WITH {_GRID}{_BOX[len(_OBS):]}, t AS (SELECT source, frame, tag_id, pos, {_TRAIL.format(50, 41)} AS n1, {_TRAIL.format(40, 31)} AS n2, {_TRAIL.format(30, 4)} AS n3 FROM s0),
lines AS (SELECT source, frame, unnest([1, 2, 3]) AS thickness, unnest([n1, n2, n3]) AS n FROM t WHERE pos > 54),
items AS (SELECT source, frame, 'label' AS kind, CASE WHEN tag_id = 7 THEN 19 ELSE 12 END AS thickness, 1 AS n, CAST(trunc(center_x) AS BIGINT) + 40 AS x FROM s0 WHERE center_x IS NOT NULL
  UNION ALL SELECT source, frame, 'trail', thickness, n, 0 FROM lines WHERE n > 0
  UNION ALL SELECT source, frame, 'box', 1, 4, CAST(trunc(box_x1) AS BIGINT) FROM box)
SELECT source, frame, kind, CAST(thickness AS INTEGER) AS thickness, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_points, CAST(sum(x) AS BIGINT) AS sum_x FROM items GROUP BY ALL""")
def render_items(spark, d):
    items = render.render_plan(_stamped(spark, d), views.boxes(spark, d), None, render.RenderParams(highlight=(7,)))
    x = F.when(F.col("kind") != "trail", F.get("points", F.lit(0))["x"]).otherwise(0).cast("long")
    return items.groupBy("source", "frame", "kind", "thickness").agg(F.count("*").alias("n_items"), F.sum(F.size("points")).alias("n_points"), F.sum(x).alias("sum_x"))


@query(f"""WITH {_BOX}, u AS (SELECT DISTINCT source, frame, round_even(center_x, 1) AS x, round_even(center_y, 1) AS y FROM obs WHERE NOT is_box)
SELECT source, frame, box_id, CASE WHEN u.x IS NOT NULL THEN 'inferred' ELSE 'open' END AS state FROM box LEFT JOIN u USING (source, frame) WHERE false
UNION ALL SELECT b.source, b.frame, b.box_id, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.source = b.source AND u.frame = b.frame AND u.x = round_even(b.center_x, 1) AND u.y = round_even(b.center_y, 1)) THEN 'inferred' ELSE 'open' END FROM box b""")
def debug_box_state(spark, d):
    cells = views.detections(spark, d).withColumn("ass_type", F.lit(3))
    return rec.box_states(views.boxes(spark, d), cells).select("source", "frame", "box_id", "state")


@query(f"""WITH {_BOX} SELECT source, frame, box_id, round((box_x1 + box_x2) / 2, 6) AS mid_x, round(center_x - 7.0, 6) AS left_x, round(center_y + 5.0, 6) AS low_y, round(center_x * 0.025, 6) AS x_mm,
 CASE WHEN box_id % 2 = 0 THEN 237 ELSE 999 END AS max_id, 'rec' || source || '__v' || frame AS video_key, printf('f%06d_c%03d', frame, box_id) AS crop_name FROM box""")
def names_and_scale(spark, d):
    x, y = F.col("center_x"), F.col("center_y")
    x1, _, _, y2 = g.xywh_to_xyxy(x, y, F.lit(14.0), F.lit(10.0))
    family = F.when(F.col("box_id") % 2 == 0, "tag36ARTag").otherwise("other")
    names = {"video_key": g.video_key(F.concat(F.lit("rec"), "source"), F.concat(F.lit("v"), F.col("frame").cast("string"))), "crop_name": g.crop_name(F.col("frame"), F.col("box_id"))}
    b = views.boxes(spark, d).withColumns({"mid_x": g.box_center(F.col("box_x1"), F.col("box_x2")), "left_x": x1, "low_y": y2, "x_mm": g.mm(x, F.lit(0.025)), "max_id": g.max_tag_id(family), **names})
    return _round(b.select("source", "frame", "box_id", "mid_x", "left_x", "low_y", "x_mm", "max_id", *names), "mid_x", "left_x", "low_y", "x_mm")


_CLOCK = "CASE WHEN {0} >= 3600 THEN printf('%02d:%02d:%02d', {0} // 3600, {0} % 3600 // 60, {0} % 60) ELSE printf('%02d:%02d', {0} % 3600 // 60, {0} % 60) END"


@query(f"""WITH {_OBS}, t AS (SELECT source, obs_id, obs_id / 7.0::DOUBLE AS sec, sqrt(obs_id::DOUBLE) + 0.013 AS el FROM obs),
u AS (SELECT *, floor(sec)::BIGINT AS s, floor(el)::BIGINT AS e, obs_id / el AS rate, CASE WHEN 12000 > obs_id THEN floor((12000 - obs_id) / (obs_id / el))::BIGINT ELSE 0 END AS lf FROM t)
SELECT source, obs_id, CASE WHEN sec < 60 THEN printf('%.1fs', sec) WHEN s >= 3600 THEN printf('%dh %02dm %02ds', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%dm %02ds', s // 60, s % 60) END AS took,
 printf('%d/12000 [%s<%s, %.2fit/s]', obs_id, {_CLOCK.format('e')}, {_CLOCK.format('lf')}, rate) AS progress FROM u""")
def time_texts(spark, d):
    i = F.col("obs_id")
    return views.observations(spark, d).select("source", "obs_id", g.duration_text(i / F.lit(7.0)).alias("took"), g.progress_line(i, F.lit(12000), F.sqrt(i.cast("double")) + 0.013).alias("progress"))


@query(f"""WITH {_SCORED}, t AS (SELECT DISTINCT source, frame, crop_idx, tag_id FROM gt), q AS (SELECT DISTINCT source, frame, crop_idx, tag_id FROM dc),
fr AS (SELECT DISTINCT source, frame, tag_id FROM gt), va AS (SELECT DISTINCT tag_id FROM gt WHERE ass_type = 1), k AS (SELECT source, frame, crop_idx, count(*) AS nt FROM t GROUP BY ALL),
m AS (SELECT q.source, q.frame, q.crop_idx, count(*) AS nf, count(t.tag_id) AS nh, count(*) FILTER (fr.tag_id IS NULL AND va.tag_id IS NOT NULL) AS nn FROM q LEFT JOIN t ON t.source = q.source AND t.frame = q.frame AND t.crop_idx = q.crop_idx AND t.tag_id = q.tag_id
  LEFT JOIN fr ON fr.source = q.source AND fr.frame = q.frame AND fr.tag_id = q.tag_id LEFT JOIN va ON va.tag_id = q.tag_id GROUP BY ALL),
c AS (SELECT lay.source, lay.frame, coalesce(nt, 0) AS nt, coalesce(nf, 0) AS nf, coalesce(nh, 0) AS nh, coalesce(nn, 0) AS nn FROM lay LEFT JOIN k ON k.source = lay.source AND k.frame = lay.frame AND k.crop_idx = lay.box_id
  LEFT JOIN m ON m.source = lay.source AND m.frame = lay.frame AND m.crop_idx = lay.box_id),
s AS (SELECT source, count(*) FILTER (nt > 0) AS total_with_gt, coalesce(sum(nt), 0)::BIGINT AS total_gt_ids, coalesce(sum(nh) FILTER (nt > 0), 0)::BIGINT AS individual_found, count(*) FILTER (nt > 0 AND nh > 0) AS correct_detections,
  count(*) FILTER (nt > 0 AND nh = nt) AS all_gt_found, coalesce(sum(nf - nh) FILTER (nt > 0), 0)::BIGINT AS false_positives, count(*) FILTER (nt = 0) AS total_no_gt, coalesce(sum(nf - nn) FILTER (nt = 0), 0)::BIGINT AS no_gt_hallucinations,
  coalesce(sum(nn) FILTER (nt = 0), 0)::BIGINT AS no_gt_discoveries, count(DISTINCT frame) AS total_composites FROM c GROUP BY source)
SELECT *, CASE WHEN total_with_gt > 0 THEN round(correct_detections / total_with_gt, 6) ELSE 0.0 END AS detection_rate, CASE WHEN total_with_gt > 0 THEN round(all_gt_found / total_with_gt, 6) ELSE 0.0 END AS all_gt_rate,
 CASE WHEN total_gt_ids > 0 THEN round(individual_found / total_gt_ids, 6) ELSE 0.0 END AS individual_recall, CASE WHEN total_with_gt > 0 THEN round(false_positives / total_with_gt, 6) ELSE 0.0 END AS false_positive_rate FROM s""")
def eval_counters(spark, d):
    crops, truth, decodes = (settle(f(spark, d)) for f in (_crops, _truth, _scored))  # each is read several times
    t = ev.testset_counters(crops, truth, decodes, truth.where("ass_type = 1"))
    return _round(t, "detection_rate", "all_gt_rate", "individual_recall", "false_positive_rate")


@query(f"WITH {_DET} SELECT sum(n)::BIGINT AS n_detections, sum(k)::BIGINT AS sum_distinct FROM (SELECT count(*) AS n, count(DISTINCT tag_id) AS k FROM det GROUP BY source, frame)")
def detection_totals(spark, d):
    return ev.detection_totals(views.detections(spark, d))


@query(f"""WITH {_SCORED}, t AS (SELECT DISTINCT p.preset, source, frame, crop_idx, tag_id FROM gt, (VALUES ('all'), ('even')) p(preset)),
q AS (SELECT DISTINCT p.preset, source, frame, crop_idx, tag_id FROM dc JOIN (VALUES ('all'), ('even')) p(preset) ON preset = 'all' OR decode_idx % 2 = 0),
j AS (SELECT coalesce(t.preset, q.preset) AS preset, t.tag_id AS a, q.tag_id AS b FROM t FULL JOIN q ON t.preset = q.preset AND t.source = q.source AND t.frame = q.frame AND t.crop_idx = q.crop_idx AND t.tag_id = q.tag_id)
SELECT preset, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS tp, count(*) FILTER (a IS NULL) AS fp, count(*) FILTER (b IS NULL) AS missed FROM j GROUP BY preset""")
def compare_decodes(spark, d):
    truth, found = _truth(spark, d), _scored(spark, d)
    every, even = (ev.crop_results(truth, f).withColumn("preset", F.lit(n)) for n, f in (("all", found), ("even", found.where("decode_idx % 2 = 0"))))
    return ev.compare_decodes(every.unionByName(even))


@query(f"WITH {_TRUTH}, n AS (SELECT tag_id, count(DISTINCT source || '/' || frame) AS n FROM gt GROUP BY tag_id) SELECT min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS median, max(n) AS most FROM n")
def id_coverage(spark, d):
    return ev.id_coverage(_truth(spark, d).groupBy("tag_id").agg(F.countDistinct("source", "frame").alias("n")))


def _manifest(spark, d):
    truth = _truth(spark, d).groupBy("source", "frame", "crop_idx").agg(F.collect_set("tag_id").alias("gt_ids"))
    crops = _crops(spark, d).join(truth, ["source", "frame", "crop_idx"], "left")
    return crops.select(F.col("source").alias("video_key"), "frame", "crop_idx", "gt_ids", F.lit("tag36ARTag").alias("tag_family"), F.lit(None).cast("string").alias("gt_mode"))


@query(f"WITH {_LAYOUT} SELECT count(DISTINCT source) AS n_videos, count(DISTINCT source || '/' || frame) AS n_composites, count(*) AS n_crops FROM lay")
def manifest_totals(spark, d):
    return ev.manifest_totals(_manifest(spark, d))


@query(f"""WITH {_TRUTH} SELECT false AS yield_mode, 'tag36ARTag' AS tag_family, (SELECT count(*) FROM lay) AS n_crops, (SELECT count(*) FROM (SELECT DISTINCT source, frame, crop_idx FROM gt)) AS n_with_gt,
 (SELECT string_agg(tag_id, ',' ORDER BY tag_id) FROM (SELECT DISTINCT tag_id FROM gt)) AS valid_ids""")
def manifest_info(spark, d):
    return ev.manifest_info(_manifest(spark, d)).withColumn("valid_ids", F.array_join("valid_ids", ","))


_RUNS = _DET + """,
runs AS (SELECT 'p' || frame % 3 AS preset, source, count(*) / 8.0::DOUBLE AS seconds, CASE WHEN count(*) % 3 = 0 THEN 'stopped' END AS error FROM det GROUP BY ALL)"""


def _runs(spark, d):
    n = views.detections(spark, d).groupBy(F.concat(F.lit("p"), (F.col("frame") % 3).cast("string")).alias("preset"), "source").count()
    return n.select("preset", "source", (F.col("count") / F.lit(8.0)).alias("seconds"), F.when(F.col("count") % 3 == 0, "stopped").alias("error"))


@query(f"WITH {_RUNS} SELECT count(*) FILTER (error IS NULL) AS n_succeeded, count(error) AS n_failed, sum(seconds) AS worker_seconds FROM runs")
def run_summary(spark, d):
    return ev.run_summary(_runs(spark, d))


@query(f"WITH {_RUNS} SELECT preset, source, seconds, row_number() OVER (PARTITION BY preset ORDER BY seconds DESC, source)::INT AS rank FROM runs")
def ranked_runtime(spark, d):
    return ev.ranked_runtime(_runs(spark, d)).select("preset", "source", "seconds", "rank")


@query("SELECT number, value FROM (SELECT o_orderkey AS number, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice::DOUBLE / 20000) END AS value FROM orders) WHERE value IS NOT NULL ORDER BY value DESC, number LIMIT 5")
def top_trials(spark, d):
    value = F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice").cast("double") / 20000).cast("double"))
    return ev.top_trials(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("number"), value.alias("value")))


_PRESETS = """pr AS (SELECT o_orderpriority AS preset, CASE WHEN o_custkey % 20 = 0 THEN '_note' ELSE 'k' || o_custkey % 20 END AS key, min(o_orderstatus || o_custkey % 3) AS value FROM orders
  WHERE o_custkey % 20 < 12 AND (length(o_orderpriority) + o_custkey) % 3 <> 0 GROUP BY ALL)"""


@query(f"""WITH {_PRESETS}, df AS (SELECT 'k' || k AS key, 'F0' AS value FROM range(16) r(k)), ks AS (SELECT DISTINCT key FROM pr WHERE key <> '_note' UNION SELECT key FROM df),
j AS (SELECT p.preset, ks.key, coalesce(pr.value, df.value, '') AS v, pr.value IS NOT NULL AS explicit FROM ks CROSS JOIN (SELECT DISTINCT preset FROM pr) p LEFT JOIN pr ON pr.preset = p.preset AND pr.key = ks.key LEFT JOIN df ON df.key = ks.key)
SELECT preset, key, v || CASE WHEN explicit THEN '*' ELSE '' END AS shown, explicit, min(v) OVER (PARTITION BY key) <> max(v) OVER (PARTITION BY key) AS differs FROM j""")
def preset_table(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").where((F.col("o_custkey") % 20 < 12) & ((F.length("o_orderpriority") + F.col("o_custkey")) % 3 != 0))
    key = F.when(F.col("o_custkey") % 20 == 0, "_note").otherwise(F.concat(F.lit("k"), (F.col("o_custkey") % 20).cast("string")))
    value = F.min(F.concat("o_orderstatus", (F.col("o_custkey") % 3).cast("string")))
    presets = o.groupBy(F.col("o_orderpriority").alias("preset"), key.alias("key")).agg(value.alias("value"))
    return ev.preset_table(presets, spark.range(16).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("F0").alias("value")))


@query("""WITH s AS (SELECT o_orderpriority AS preset, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT preset, 'recall' AS metric, (n % 97)::DOUBLE AS value FROM s UNION ALL SELECT preset, 'fp_rate', (n % 13)::DOUBLE FROM s UNION ALL SELECT preset, 'avg_ms', (n % 2)::DOUBLE FROM s)
SELECT metric, preset, value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'recall' THEN value ELSE -value END DESC, preset) AS k FROM m) WHERE k = 1""")
def best_presets(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("preset")).count()
    s = n.select("preset", *[(F.col("count") % m).cast("double").alias(k) for k, m in (("recall", 97), ("fp_rate", 13), ("avg_ms", 2))])
    return ev.best_presets(s.unpivot("preset", ["recall", "fp_rate", "avg_ms"], "metric", "value").withColumn("place", F.col("preset")))
