"""Tracks are scanned in one order and shuffled once."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_shared_reads import DATA
from tests.test_tracking import detections_of
from waymark import catalog
from waymark.operators import trajectory as tr
from waymark.plans.clean import clean_cells
from waymark.schema import CleanParams
from waymark.sources import views


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_grid_is_sorted_once(spark):
    d = detections_of(spark, [(f, t, f, 0) for f in range(30) for t in (1, 2)])
    plan = plan_of(clean_cells(d, None, CleanParams(min_detections=1, n_frames=40, final_jump_pass=True)))
    assert plan.count("Sort [") == 2 and " DESC " not in plan  # detections, then the grid


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_the_numbering_shares_the_shuffle_of_tracks(spark):
    assert plan_of(catalog.clean_no_boxes(spark, DATA)).count("Exchange") == 1
    order = lambda d: [(r["source"], r["tag_id"], r["frame"], r["center_x"], r["c0x"]) for r in d.orderBy("source", "tag_id", "frame", "det_id").collect()]
    assert order(views.track_detections(spark, DATA)) == order(views.detections(spark, DATA))


def test_of_several_detections_one_stays(spark):
    d = detections_of(spark, [(0, 1, 0, 0), (1, 1, 50, 0), (1, 1, 2, 0), (1, 1, 2, 0), (2, 1, 2, 0), (3, 1, -1, 0), (3, 1, 9, 9), (0, 2, 7, 7), (0, 2, 1, 1)]).withColumn("center_x", F.when(F.col("center_x") != -1, F.col("center_x")))
    got = {(r["tag_id"], r["frame"]): r for r in tr.resolve_duplicates(d).collect()}
    assert len(got) == 5 and tr.resolve_duplicates(d).count() == 5
    at = lambda t, f: (got[t, f]["center_x"], got[t, f]["center_y"])
    assert at(1, 1) == (2.0, 0.0) and at(1, 3) == (9.0, 9.0) and at(2, 0) == (7.0, 7.0)
    assert got[1, 1]["det_id"] == min(r["det_id"] for r in d.where(F.col("center_x") == 2).where("frame = 1").collect())


def test_scans_carry_few_columns(spark):
    d = detections_of(spark, [(f, t, f, 0) for f in range(30) for t in (1, 2)])
    cells = clean_cells(d, None, CleanParams(min_detections=1, n_frames=40))
    grid = plan_of(cells).split("Generate explode")[0]
    assert "c0x#" not in grid.split("Window [", 1)[1] and "n_pruned" not in grid.split("Window [", 1)[1]  # nothing of them in the scans of the grid
    kept = cells.where("ass_type = 1")
    assert kept.count() == kept.where("c0x IS NOT NULL AND c3y IS NOT NULL").count() == 60 and cells.where("ass_type <> 1 AND c0x IS NOT NULL").count() == 0
    assert {c: cells.agg(F.sum(c)).first()[0] for c in ("n_deleted", "n_filled", "n_final_deleted")} == {"n_deleted": 0, "n_filled": 0, "n_final_deleted": 0}
