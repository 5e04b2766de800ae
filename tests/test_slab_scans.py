"""Scans by slabs store and shuffle rows, nothing that follows from them, and as few times as they can."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_scans import detections
from waymark.operators import scan
from waymark.operators import trajectory as tr
from waymark.plans.clean import clean_cells
from waymark.schema import CleanParams


def test_what_a_plan_by_slabs_settles(spark, monkeypatch):
    stored, settle = [], scan.settle
    monkeypatch.setattr(scan, "settle", lambda df: stored.append(df.columns) or settle(df))
    d = detections(spark, n=150)
    clean_cells(d, None, CleanParams(min_detections=20, max_jump=60.0, n_frames=150, slab=40))
    assert len(stored) == 4  # duplicates, moves with the first filling and its steps, jumps, the second filling with its steps
    assert not [c for columns in stored for c in columns if c.startswith(("_v", "_p_", "_n_"))]


@pytest.mark.parametrize("slab", [None, 7])
def test_steps_of_filled_cells_in_one_scan(spark, slab):
    rng = np.random.default_rng(3)
    rows = [("s", t, int(p), int(p), *((float(rng.normal()), float(rng.normal())) if rng.random() < 0.3 else (None, None)), 1) for t in range(4) for p in range(60) if rng.random() < 0.9]
    cells = spark.createDataFrame(rows, "source string, tag_id long, pos int, frame int, center_x double, center_y double, ass_type int")
    cells = cells.withColumn("ass_type", F.when(F.col("center_x").isNotNull(), 1).otherwise(0))
    for limit in (0, 2, 50):
        apart = tr.step_distance(tr.interpolate(tr.with_moves(cells), limit))
        once = tr.interpolate(cells, limit, slab=slab, moves=True, steps=True)
        by = lambda df: sorted(map(repr, (tuple(r[c] for c in ("tag_id", "pos", "center_x", "center_y", "distance", "move_px")) for r in df.collect())))
        assert by(once) == by(apart) and once.where("distance IS NOT NULL").count() > 5
