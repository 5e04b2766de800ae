"""What is read or shuffled once, and what isn't copied."""

import os

import pytest
from pyspark.sql import functions as F

from waymark.operators import near
from waymark.sources import views

DATA = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_detections_and_boxes_share_one_shuffle_of_observations(spark):
    d = views.detections(spark, DATA).groupBy("source").agg(F.sum("center_x"), F.max("det_id"))
    b = views.boxes(spark, DATA).groupBy("source").agg(F.sum("confidence"), F.max("box_id"))
    assert "ReusedExchange" in executed(d.join(b, "source"))


def test_a_point_meets_four_cells(spark):
    points = spark.range(50).select(F.lit(1).alias("g"), "id", F.col("id").cast("double").alias("center_x"), (F.col("id") % 7).cast("double").alias("center_y"), F.lit(3.0).alias("r"))
    plan = near.near_pairs(points, points, ["g"], "r")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[1,1]") == 1 and "[-1,-1]" not in plan


def test_suppression_takes_many_frames_a_call(spark, monkeypatch):
    import numpy as np

    from waymark.operators import boxes as bx

    rng = np.random.default_rng(3)
    rows = [("s", int(f), k, float(x), float(y), float(x + 10), float(y + 10), float(rng.integers(0, 4)), int(c)) for f in range(150) for k, (x, y, c) in enumerate(zip(rng.integers(0, 40, 12), rng.integers(0, 20, 12), rng.integers(0, 2, 12), strict=True))]
    df = spark.createDataFrame(rows, "source string, frame int, box_id long, box_x1 double, box_y1 double, box_x2 double, box_y2 double, confidence double, class_id int")
    got = {(r["frame"], r["box_id"]) for r in bx.suppress(df, 0.3, 5).collect()}
    want = set()
    for f in range(150):
        kept = []
        for r in sorted((r for r in rows if r[1] == f), key=lambda r: (-r[7], r[2])):
            over = lambda a, b: max(min(a[5], b[5]) - max(a[3], b[3]), 0) * max(min(a[6], b[6]) - max(a[4], b[4]), 0)
            if all(a[8] != r[8] or not over(a, r) > 0.3 * (200 - over(a, r)) for a in kept):
                kept.append(r)
        want |= {(f, r[2]) for r in kept[:5]}
    assert got == want
    assert "_some" in bx.suppress(df, 0.3)._jdf.queryExecution().analyzed().toString()


def test_only_seen_cells_go_to_the_kernel(spark):
    from tests.test_chains import scene
    from waymark.operators import matching as mt

    cells, boxes = scene(spark, 1)
    seen = cells.where("ass_type IN (1, 3)").count()
    taken = []
    run = mt._run
    mt._run = lambda c, b, work: taken.append(c.count()) or run(c, b, work)
    try:
        assert mt.chain_fill(cells, boxes).count() > 0
    finally:
        mt._run = run
    assert taken == [seen] and seen < cells.count()


def test_settled_rows_are_stored_by_columns(spark):
    from waymark.operators.lineage import settle

    plan = settle(spark.range(10).withColumn("x", F.lit(None).cast("double"))).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_every_round_of_propagation_is_settled(spark):
    from waymark.llm import op3_urls

    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "src string, dst string")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 1.0)], "kind string, host string, share double")
    scores = op3_urls.propagate(edges, seeds)
    assert scores._jdf.queryExecution().analyzed().toString().count("Join ") == 2  # the last round's; the driver holds no more broadcasts than these
    assert scores.count() > 0
