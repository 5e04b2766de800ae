"""Operators on hand-made tracks, and invariants of the whole plan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymark.operators import boxes as bx
from waymark.operators import matching as mt
from waymark.operators import metrics as me
from waymark.operators import trajectory as tr
from waymark.plans.clean import clean
from waymark.schema import BOXES, DETECTIONS, CleanParams, EmptyTrackingError

CELL = "source string, frame int, pos int, tag_id long, center_x double, center_y double, ass_type int"


def cells_of(spark, tracks, kinds=None):
    """Cells of {tag: [x or None, ..]} on y = 0."""
    rows = [("s", i, i, tag, x, None if x is None else 0.0, kinds[tag][i] if kinds else int(x is not None)) for tag, xs in tracks.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, CELL)


def by_tag(df, column="center_x"):
    out = {}
    for r in df.orderBy("tag_id", "pos").collect():
        out.setdefault(r["tag_id"], []).append(r[column])
    return out


def detections_of(spark, rows, side=10.0):
    half = side / 2
    full = [("s", f, k, t, float(x), float(y), *[float(v) for v in (x - half, y + half, x + half, y + half, x + half, y - half, x - half, y - half)]) for k, (f, t, x, y) in enumerate(rows)]
    return spark.createDataFrame(full, DETECTIONS)


def boxes_of(spark, rows):
    return spark.createDataFrame([("s", f, k, x - 5.0, y - 5.0, x + 5.0, y + 5.0, float(x), float(y), 0.9, False, -1) for k, (f, x, y) in enumerate(rows)], BOXES)


def test_duplicates_follow_the_track(spark):
    d = detections_of(spark, [(0, 1, 0, 0), (1, 1, 90, 0), (1, 1, 11, 0), (2, 1, 20, 0), (3, 2, 5, 5), (3, 2, 6, 5)])
    got = {(r["tag_id"], r["frame"]): r["center_x"] for r in tr.resolve_duplicates(d).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 11.0, (1, 2): 20.0, (2, 3): 5.0}


def test_grid_has_every_frame(spark):
    d = detections_of(spark, [(1, 1, 0, 0), (4, 2, 0, 0), (9, 1, 3, 3)])
    assert tr.dense_grid(d, 5).count() == 10
    sparse = tr.dense_grid(d)
    assert sparse.count() == 6 and {r["pos"] for r in sparse.collect()} == {0, 1, 2}


@pytest.mark.parametrize(
    ("given", "limit", "expected"),
    [([1, None, 3, None, None, 6], 2, [1, 2, 3, 4, 5, 6]), ([None, None, 3, 4, None, None], 5, [None, None, 3, 4, None, None]), ([1, *[None] * 7, 9], 2, [1, 2, 3, None, None, None, 7, 8, 9])],
)
def test_interpolation(spark, given, limit, expected):
    assert by_tag(tr.interpolate(cells_of(spark, {1: [None if v is None else float(v) for v in given]}), limit))[1] == expected


def test_interpolation_has_the_nulls_of_pandas(spark):
    rng = np.random.default_rng(3)
    tracks = {t: [None if rng.random() < 0.5 else float(rng.integers(100)) for _ in range(60)] for t in range(5)}
    for limit in (1, 3):
        got = by_tag(tr.interpolate(cells_of(spark, tracks), limit))
        for t, xs in tracks.items():
            want = pd.Series(xs, dtype=float).interpolate(limit=limit, limit_direction="both", limit_area="inside")
            np.testing.assert_allclose(np.array(got[t], float), want.to_numpy(), atol=1e-9)


def test_jump_blocks_keep_the_last_original(spark):
    c = cells_of(spark, {1: [0.0, 1.0, 100.0, 300.0, 301.0], 2: [0.0, 1.0, 2.0, 3.0, 4.0]})
    out = tr.drop_jumps(tr.step_distance(c), 50.0)
    assert by_tag(out) == {1: [0.0, 1.0, None, 300.0, 301.0], 2: [0.0, 1.0, 2.0, 3.0, 4.0]}
    kinds = {1: [1, 2, 2, 1, 1]}
    out = tr.drop_jumps(tr.step_distance(cells_of(spark, {1: [0.0, 1.0, 100.0, 101.0, 102.0]}, kinds)), 50.0)
    assert by_tag(out)[1] == [0.0, None, None, 101.0, 102.0]  # the interpolated cell before the run goes too


def test_min_detections(spark):
    c = cells_of(spark, {10: [1.0 if i % 4 == 0 else None for i in range(40)], 20: [1.0] * 40})
    assert set(by_tag(tr.min_detections(c, 11))) == {20} and set(by_tag(tr.min_detections(c, 10))) == {10, 20}
    with pytest.raises(EmptyTrackingError):
        tr.require_rows(tr.min_detections(c, 100))


def test_pixel_scale(spark):
    d = detections_of(spark, [(f, t, 100 * t, f) for f in range(30) for t in (1, 2)], side=50.0)
    r = me.pixel_scale(d).first()
    assert (r["tag_px"], r["n_quads"]) == (50.0, 60) and r["mm_per_px"] == pytest.approx(0.4 / 50)
    empty = me.pixel_scale(d.withColumn("c0x", F.lit(None).cast("float"))).first()
    assert empty["tag_px"] is None and empty["n_quads"] == 0


def matched(spark, tracks, boxes, reach, work=mt.chain_fill, **more):
    fills = work(cells_of(spark, tracks).withColumn("reach", F.lit(float(reach))), boxes_of(spark, boxes), **more)
    return sorted((r["tag_id"], r["pos"], r["center_x"], r["direction"]) for r in fills.collect())


def test_forward_fill(spark):
    assert matched(spark, {1: [0.0, None, None, 30.0]}, [(1, 10, 0), (2, 20, 0)], 15) == [(1, 1, 10.0, "forward"), (1, 2, 20.0, "forward")]


def test_far_box_and_leading_edge(spark):
    assert matched(spark, {1: [0.0, None, 20.0]}, [(1, 500, 500)], 20) == []
    assert matched(spark, {1: [None, None, None, 0.0]}, [(f, 0, 0) for f in range(3)], 5) == [(1, k, 0.0, "backward") for k in range(3)]


def test_chain_breaks_after_misses(spark):
    boxes = [*[(f, 0, 0) for f in (1, 2, 3)], *[(f, 900, 0) for f in (4, 5, 6)], (7, 0, 0)]
    got = matched(spark, {1: [0.0, *[None] * 7]}, boxes, 10, max_misses=3)
    assert [g[1] for g in got] == [1, 2, 3]


def test_nearest_tag_gets_the_box(spark):
    got = matched(spark, {1: [0.0, None, 0.0], 2: [100.0, None, 100.0]}, [(1, 102, 0), (1, 1, 0)], 20)
    assert {g[0]: g[2] for g in got} == {1: 1.0, 2: 102.0}


def test_ambiguous_claims_are_pruned_and_banned(spark):
    tracks = {1: [0.0, None, None, None, 200.0], 2: [200.0, None, None, None, 0.0]}
    boxes = [(2, 10, 0)]
    cells = cells_of(spark, tracks).withColumn("reach", F.lit(15.0))
    fills = mt.chain_fill(cells, boxes_of(spark, boxes))
    assert {(r["tag_id"], r["direction"]) for r in fills.collect()} == {(1, "forward"), (2, "backward")}
    pruned, bans = mt.prune_ambiguous(mt.apply_fills(cells, fills), mt.ambiguous_claims(fills))
    assert pruned.where("ass_type = 3").count() == 0 and bans.count() == 2 and pruned.where("n_pruned = 1").count() == 6
    assert mt.rechain(pruned.drop("allowed"), mt.ban_boxes(boxes_of(spark, boxes), bans)).count() == 0


def test_long_gaps_follow_the_motion(spark):
    xs = [0.0, 10.0, *[None] * 12, 140.0]
    boxes = [(i, 10 * i, 0) for i in range(2, 14)] + [(2, 12, 0)]
    got = matched(spark, {1: xs}, boxes, 30, work=mt.recover_long_gaps, min_gap=10)
    assert [g[2] for g in got] == [10.0 * i for i in range(2, 14)]
    assert matched(spark, {1: xs}, boxes, 30, work=mt.recover_long_gaps, min_gap=12) == []


def test_suppression(spark):
    rows = [("s", 0, 0, 0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 0.9, False, -1), ("s", 0, 1, 1.0, 0.0, 11.0, 10.0, 6.0, 5.0, 0.8, False, -1), ("s", 0, 2, 50.0, 0.0, 60.0, 10.0, 55.0, 5.0, 0.7, False, -1)]
    b = spark.createDataFrame(rows, BOXES).withColumn("class_id", F.lit(0))
    assert sorted(r["box_id"] for r in bx.suppress(b, 0.4).collect()) == [0, 2]
    assert bx.suppress(b, 0.4, most=1).count() == 1


def random_walk(spark, frames=120, tags=6):
    rng = np.random.default_rng(123)
    rows = []
    for t in range(tags):
        xy = 500 + np.cumsum(rng.normal(0, 2, (frames, 2)), 0)
        if t % 2 == 0:
            xy[frames // 2] += 500
        rows += [(f, t, *xy[f]) for f in range(frames) if rng.random() > 0.05]
    return detections_of(spark, rows)


def test_whole_plan_keeps_its_invariants(spark):
    d = random_walk(spark)
    boxes = boxes_of(spark, [(f, 500.0 + f % 7, 500.0) for f in range(0, 120, 3)])
    p = CleanParams(min_detections=10, max_jump=100.0, n_frames=120, recover_long_gaps=True, final_jump_pass=True)
    cells, metrics = clean(d, boxes, p)
    c = cells.toPandas()
    m = metrics.first()
    assert len(c) == 120 * 6 and not c.duplicated(["source", "pos", "tag_id"]).any()
    assert ((c.ass_type == 0) == c.center_x.isna()).all() and (c.ass_type[c.c0x.notna()] == 1).all()
    truth = {(r["frame"], r["tag_id"]): r["center_x"] for r in d.collect()}
    kept = c[c.ass_type == 1]
    assert all(truth[f, t] == x for f, t, x in zip(kept.frame, kept.tag_id, kept.center_x, strict=True))
    spots = {(r["frame"], r["center_x"], r["center_y"]) for r in boxes.collect()}
    inferred = c[c.ass_type == 3]
    assert all((f, x, y) in spots for f, x, y in zip(inferred.frame, inferred.center_x, inferred.center_y, strict=True))
    assert m["total_samples"] == 720 and m["original_bad_count"] >= 3 and all(0 <= m[k] <= 100 for k in m.asDict() if k.endswith("pct"))
    again = clean(d.repartition(7), boxes.repartition(3), p)[0].toPandas()
    order = ["tag_id", "pos"]
    pd.testing.assert_frame_equal(c.sort_values(order).reset_index(drop=True), again.sort_values(order).reset_index(drop=True))


def test_backward_is_forward_in_reverse(spark):
    d = random_walk(spark, 60, 3)
    cells = tr.stamp_original(tr.dense_grid(d, 60)).withColumn("reach", F.lit(20.0))
    boxes = boxes_of(spark, [(f, 500.0 + f % 5, 500.0) for f in range(60)])
    turn = lambda df: df.withColumn("frame", 59 - F.col("frame"))
    fills = mt.chain_fill(turn(cells).withColumn("pos", F.col("frame")), turn(boxes))
    there = mt.chain_fill(cells, boxes)
    first = lambda df, way: df.where(F.col("direction") == way).count()
    assert first(there, "forward") + first(there, "backward") == there.count() and fills.count() > 0
