"""What is drawn, the colours, and what a run leaves behind."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_scans import detections
from tests.test_tracking import CELL, boxes_of, detections_of
from waymark import sources
from waymark.operators import evaluate as ev
from waymark.operators import recordings as rec
from waymark.plans import render
from waymark.plans.clean import clean_cells, clean_to
from waymark.schema import CleanParams


def test_trails_get_thicker(spark):
    cells = spark.createDataFrame([("s", i, i, 1, float(i), 0.0, 1) if i % 2 else ("s", i, i, 1, None, None, 0) for i in range(60)], CELL)
    got = {r["pos"]: [(p["center_x"], p["thickness"]) for p in r["trail"]] for r in rec.trails(cells).where("trail IS NOT NULL").collect()}
    assert set(got) == set(range(55, 60))
    assert got[55] == [(float(x), 1 if x - 5 < 10 else 2 if x - 5 < 20 else 3) for x in range(5, 52) if x % 2]


def test_items_of_a_frame(spark):
    cells = spark.createDataFrame([("s", i, i, t, 10.7 * t + i, 5.2, 1) for i in range(58) for t in (1, 2)] + [("s", 58, 58, 1, None, None, 0), ("s", 58, 58, 2, 30.0, 6.0, 3)], CELL)
    boxes = boxes_of(spark, [(58, 30, 6), (58, 90, 6)])
    got = render.render_plan(cells, boxes, None, render.RenderParams(highlight=(2,), highlight_color=sources.parse_color("0,128,255"))).where("frame = 58").orderBy("layer", "tag_id", "thickness").collect()
    assert [(r["kind"], r["tag_id"], r["thickness"]) for r in got] == [("label", 2, 19), *[("trail", t, k) for t in (1, 2) for k in (1, 2, 3)], ("box", None, 1), ("box", None, 1)]
    assert got[0]["text"] == "2" and tuple(got[0]["color"]) == (255, 128, 0) and tuple(got[0]["points"][0]) == (70, 46)
    assert [len(r["points"]) for r in got[1:4]] == [10, 10, 27] and got[1]["color"] != got[4]["color"]
    assert tuple(got[1]["color"]) == sources.tag_colors([1, 2])[1]
    debug = render.render_plan(cells, boxes, None, render.RenderParams(debug=True, trails=False)).where("frame = 58 AND kind = 'box'").collect()
    assert sorted(tuple(r["color"]) for r in debug) == sorted([sources.COLORS["yellow"], sources.COLORS["red"]])
    half = render.render_plan(cells, None, None, render.RenderParams(scale=0.5, trails=False)).where("frame = 58").first()
    assert tuple(half["points"][0]) == (35, 23) and half["thickness"] == 6
    assert render.render_plan(cells.limit(0), boxes.limit(0)).count() == 0


def test_quads_are_drawn(spark):
    d = detections_of(spark, [(0, 1, 50, 50)])
    cells = clean_cells(d, None, CleanParams(min_detections=1, n_frames=2))
    got = render.render_plan(cells, None, d, render.RenderParams(debug=True, trails=False)).where("kind = 'quad'").collect()
    assert {tuple(r["color"]) for r in got} == {sources.COLORS["white"], sources.COLORS["green"]} and all(r["closed"] and len(r["points"]) == 4 for r in got)


@pytest.mark.parametrize(("text", "bgr"), [("Red", (0, 0, 255)), (" cyan ", (255, 255, 0)), ("1, 2,3", (3, 2, 1)), ("255,0,0", (0, 0, 255))])
def test_colors(text, bgr):
    assert sources.parse_color(text) == bgr


@pytest.mark.parametrize("text", ["", "pink", "1,2", "1,2,x", "256,0,0", "-1,0,0", "1,2,3,4"])
def test_odd_colors(text):
    with pytest.raises(ValueError, match="colour|channels"):
        sources.parse_color(text)


def test_snapshots_and_skipped_recordings(spark, tmp_path):
    d = detections(spark).unionByName(detections(spark).where("frame < 4").withColumn("source", F.lit("short")))
    boxes = boxes_of(spark, [(f, 10 * t + 2, 5 * t) for f in range(0, 300, 2) for t in range(4)])
    params = CleanParams(min_detections=20, max_jump=60.0, n_frames=300, recover_long_gaps=True, final_jump_pass=True)
    kept = CleanParams(**(params.__dict__ | {"snapshots": str(tmp_path / "snap")}))
    run = clean_to(str(tmp_path / "cells"), d, boxes, kept)
    assert sorted(os.listdir(tmp_path / "snap")) == [f"after_{s}.parquet" for s in ("fill", "final_jump", "jump", "prune", "rechain", "recovery")]
    assert [r["source"] for r in run.skipped.collect()] == ["short"]
    whole = clean_cells(d, boxes, params)
    assert run.cells.count() == whole.count() and run.cells.exceptAll(whole.select(*run.cells.columns)).count() == 0


def test_valid_ids_meet_once(spark):
    crops = spark.createDataFrame([("v", 1, "f", [3, 1], None), ("v", 2, "f", [3], None), ("w", 1, "f", [], None), ("w", 1, "f", None, None)], "video_key string, frame int, tag_family string, gt_ids array<long>, gt_mode string")
    r = ev.manifest_info(crops).first()
    assert r["valid_ids"] == [1, 3] and r["n_crops"] == 4 and r["n_with_gt"] == 2
    assert ev.manifest_info(crops.limit(0)).first()["valid_ids"] == []
