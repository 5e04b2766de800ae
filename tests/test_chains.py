"""Chains by joins against the recording's kernel, and near joins against all pairs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tracking import CELL, boxes_of
from waymark import catalog
from waymark.operators import chains, near
from waymark.operators import matching as mt
from waymark.operators import trajectory as tr
from waymark.operators.lineage import settle
from waymark.plans.clean import clean_cells
from waymark.schema import CleanParams
from waymark.sources import views

DATA = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(repr, [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]))


def scene(spark, seed, n=120, tags=5, reach=12.0):
    rng = np.random.default_rng(seed)
    cells, boxes = [], []
    for tag in range(tags):
        x = np.cumsum(rng.normal(0, 2, n)) + 9 * tag
        for i in range(n):
            known = rng.random() < 0.25
            cells.append(("s", i, i, tag, float(x[i]) if known else None, 0.0 if known else None, int(rng.choice([1, 1, 2])) if known else 0))
            if rng.random() < 0.4:
                boxes.append((i, float(round(x[i] + rng.normal(0, 1), 1)), float(rng.integers(0, 3))))
    return spark.createDataFrame(cells, CELL).withColumn("reach", F.lit(reach)), boxes_of(spark, boxes)


@pytest.mark.parametrize(("seed", "misses", "limit"), [(1, 10, 0), (2, 3, 0), (3, 10, 2), (4, 1, 0)])
def test_walks_give_what_the_kernel_gives(spark, seed, misses, limit):
    cells, boxes = (settle(x) for x in scene(spark, seed))
    want = rows_of(mt.chain_fill(cells, boxes, misses, limit))
    assert rows_of(chains.chain_fill(cells, boxes, misses, limit)) == want and want


def test_endless_reach_and_nothing_to_walk(spark):
    cells, boxes = scene(spark, 5, n=30, tags=3, reach=float("inf"))
    cells, boxes = settle(cells), settle(boxes)
    assert rows_of(chains.chain_fill(cells, boxes)) == rows_of(mt.chain_fill(cells, boxes))
    assert chains.chain_fill(cells, settle(boxes.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_walks_over_a_whole_table(spark):
    cells, boxes = settle(catalog._jumped(spark, DATA)), settle(views.boxes(spark, DATA))
    params = CleanParams(**(catalog.PARAMS.__dict__ | {"min_detections": 5}))
    cells = settle(mt.with_reach(clean_cells(views.detections(spark, DATA), None, params).drop("distance"), catalog.me.pixel_scale(views.detections(spark, DATA)), 2.0))
    want = rows_of(mt.chain_fill(cells, boxes))
    assert rows_of(chains.chain_fill(cells, boxes)) == want and len(want) > 100


def test_the_plan_by_slabs_with_boxes(spark):
    from tests.test_scans import detections

    d = detections(spark, n=150)
    boxes = settle(boxes_of(spark, [(f, 10 * t + 2, 5 * t) for f in range(0, 150, 2) for t in range(4)]))
    whole = CleanParams(min_detections=20, max_jump=60.0, n_frames=150, recover_long_gaps=True, min_gap=3, final_jump_pass=True)
    assert rows_of(clean_cells(d, boxes, whole)) == rows_of(clean_cells(d, boxes, CleanParams(**(whole.__dict__ | {"slab": 40}))))


def test_rechain_and_recovery_by_stretches(spark):
    cells, boxes = (settle(x) for x in scene(spark, 11, n=150))
    cells = settle(tr.step_distance(cells))
    fills = settle(mt.chain_fill(cells, boxes))
    pruned, bans = mt.prune_ambiguous(mt.apply_fills(cells, fills), mt.ambiguous_claims(fills))
    pruned, bans = settle(pruned), settle(bans)
    assert bans.count() > 5
    for given in (pruned, pruned.drop("allowed")):
        want = rows_of(mt.rechain(given, mt.ban_boxes(boxes, bans)))
        assert rows_of(chains.rechain(given, boxes, bans)) == want and want
    sparse = settle(cells.withColumns({c: F.when((F.col("pos") + F.col("tag_id") * 7) % 40 < 6, F.col(c)) for c in ("center_x", "center_y")}).withColumn("ass_type", F.when(F.col("center_x").isNotNull(), F.col("ass_type")).otherwise(0)))
    want = rows_of(mt.recover_long_gaps(sparse, boxes, 5))
    assert rows_of(chains.recover_long_gaps(sparse, boxes, 5)) == want and len(want) > 20
    later = settle(mt.apply_fills(sparse, settle(mt.chain_fill(sparse, boxes, 2))))  # with boxes in use
    assert rows_of(chains.recover_long_gaps(later, boxes, 5)) == rows_of(mt.recover_long_gaps(later, boxes, 5))


def test_a_chain_of_boxes_is_walked_to_its_end(spark):
    cells = spark.createDataFrame([("s", i, i, 1, 0.0 if i == 0 else None, 0.0 if i == 0 else None, int(i == 0)) for i in range(70)], CELL).withColumn("reach", F.lit(5.0))
    boxes = settle(boxes_of(spark, [(i, 3.0 * i, 0) for i in range(1, 70) if i % 3]))
    got = chains.single_walks(settle(cells), boxes, "forward")
    assert sorted(r["pos"] for r in got.collect()) == [1, 2]  # two misses of 3 are too far: 9 px
    boxes = settle(boxes_of(spark, [(i, 3.0 * i, 0) for i in range(1, 70)]))
    got = chains.single_walks(settle(cells), boxes, "forward").collect()
    assert sorted(r["pos"] for r in got) == list(range(1, 70)) and {r["distance"] for r in got} == {3.0}


@pytest.mark.parametrize("radius", [0.0, 0.7, 3.0, 1000.0])
def test_near_pairs_are_all_pairs(spark, radius):
    rng = np.random.default_rng(6)
    point = lambda k: (int(rng.integers(0, 3)), k, float(rng.integers(-9, 9)) * 0.7, float(rng.integers(-9, 9)) * 0.7)
    a, b = [point(k) for k in range(80)], [point(k) for k in range(80)] + [(1, 80, None, 0.0)]
    frames = [spark.createDataFrame(x, "g int, n int, center_x double, center_y double").withColumn("r", F.lit(radius)) for x in (a, b)]
    got = sorted((r["n"], r["right_n"]) for r in near.near_pairs(*frames, ["g"], "r").collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and q[2] is not None and np.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) <= radius)
    plan = near.near_pairs(*frames, ["g"], "r")._jdf.queryExecution().optimizedPlan().toString()
    assert "_cx" in plan and "Cartesian" not in plan
