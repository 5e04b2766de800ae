"""Scans by slabs, exact quantiles, and the record of a cleaning run."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tracking import CELL, boxes_of, detections_of
from waymark.operators import quantiles as qt
from waymark.operators import quads as qu
from waymark.operators import recordings as rec
from waymark.operators import trajectory as tr
from waymark.operators.scan import look
from waymark.plans.clean import clean, clean_cells, clean_to, run_attributes
from waymark.schema import CleanParams, EmptyTrackingError


def track(spark, n=400, tags=3, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for tag in range(tags):
        for i in range(n):
            known = rng.random() < (0.3 if (i // 70) % 2 else 0.8)
            x = float(rng.integers(0, 90)) if known else None
            y = None if x is None or rng.random() < 0.02 else float(rng.integers(0, 9))
            rows.append(("s", i, i, tag, x, y, int(rng.choice([1, 2])) if known else 0))
    return spark.createDataFrame(rows, CELL)


def rows_of(df):
    return sorted(map(repr, [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]))


@pytest.mark.parametrize("slab", [1, 7, 64, 1000])
def test_slabs_give_what_whole_tracks_give(spark, slab):
    c = track(spark)
    for whole, cut in [
        (tr.interpolate(c, 2), tr.interpolate(c, 2, slab=slab)),
        (tr.step_distance(c), tr.step_distance(c, slab=slab)),
        (tr.with_moves(c), tr.with_moves(c, slab=slab)),
        (tr.drop_jumps(tr.step_distance(c), 30.0), tr.drop_jumps(tr.step_distance(c), 30.0, slab=slab)),
        (tr.enclosing_originals(c), tr.enclosing_originals(c, slab=slab)),
        (tr.gap_runs(c, 3), tr.gap_runs(c, 3, slab=slab)),
    ]:
        assert rows_of(whole) == rows_of(cut)


def test_both_ways_give_the_same(spark):
    c = track(spark)
    assert rows_of(tr.interpolate(c, 2, "desc")) == rows_of(tr.interpolate(c, 2)) and rows_of(tr.with_moves(c, "desc")) == rows_of(tr.with_moves(c))
    stepped = tr.step_distance(c, "desc")
    assert rows_of(stepped) == rows_of(tr.step_distance(c)) and rows_of(tr.drop_jumps(stepped, 30.0, "asc")) == rows_of(tr.drop_jumps(stepped, 30.0, "desc"))


def test_look_at_the_edges_of_slabs(spark):
    rows = spark.createDataFrame([("s", 0, i, 1, v, None, 1) for i, v in enumerate([None, 1.0, None, None, None, 5.0, None])], CELL)
    got = look(rows, {"b": F.col("center_x")}, {"a": F.col("center_x")}, {"p": F.col("center_x")}, {"f": F.col("center_x")}, slab=2).orderBy("pos").collect()
    assert [r["b"] for r in got] == [None, None, 1.0, 1.0, 1.0, 1.0, 5.0] and [r["a"] for r in got] == [1.0, 5.0, 5.0, 5.0, 5.0, None, None]
    assert [r["p"] for r in got] == [None, None, 1.0, None, None, None, 5.0] and [r["f"] for r in got] == [1.0, None, None, None, 5.0, None, None]


def detections(spark, n=300, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(int(f), int(t), 10 * t + rng.random() * 5 + (200 if rng.random() < 0.05 else 0), 5.0 * t) for t in range(4) for f in rng.choice(n, int(n * 0.6), replace=False)]
    return detections_of(spark, rows + [(f, t, 10 * t + 90, 0.0) for f, t, *_ in rows[::9]])  # some frames twice


@pytest.mark.parametrize("n_frames", [None, 300, 250])
def test_the_plan_by_slabs(spark, n_frames):
    d = detections(spark)
    whole = CleanParams(min_detections=20, max_jump=60.0, n_frames=n_frames, final_jump_pass=True)
    cut = CleanParams(**(whole.__dict__ | {"slab": 37}))
    assert rows_of(clean_cells(d, None, whole)) == rows_of(clean_cells(d, None, cut))


def test_a_long_track_is_spread_over_tasks(spark):
    d = detections_of(spark, [(f, 1, f % 50, 0.0) for f in range(0, 30_000, 3)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = clean_cells(d, None, CleanParams(min_detections=1, n_frames=30_000, slab=1000))
        sizes = cells.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in sizes) == 30_000 and len(sizes) == 4 and max(r["count"] for r in sizes) < 20_000


def test_a_small_recording_keeps_its_tasks(spark):
    cells = clean_cells(detections(spark), None, CleanParams(min_detections=20, n_frames=300))
    assert cells.rdd.getNumPartitions() == 4  # run-time coalescing leaves the number of the shuffle alone
    plan = cells._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert final.count("Exchange hashpartitioning") == 1 and final.count("Sort [") <= 8


def test_grid_fills_up_from_detections(spark):
    d = detections_of(spark, [(-3, 1, 0, 0), (2, 1, 1, 0), (5, 1, 2, 0), (9, 1, 3, 0), (8, 2, 4, 0), (-1, 3, 5, 0)])
    got = {}
    for r in tr.dense_grid(d, 7).orderBy("pos").collect():
        assert r["frame"] == r["pos"]
        got.setdefault(r["tag_id"], []).append(r["center_x"])
    assert got == {1: [None, None, 1.0, None, None, 2.0, None], 2: [None] * 7, 3: [None] * 7}
    sparse = {r["frame"]: r["pos"] for r in tr.dense_grid(d, slab=2).where("tag_id = 1").collect()}
    assert sparse == {-3: 0, -1: 1, 2: 2, 5: 3, 8: 4, 9: 5}


SPECIAL = [0.0, -0.0, 1.0, -1.0, 0.1, 1e-300, 5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -5e-324, -1e308, 3.0, 4.0, 0.9999999999999999, 1e15, float("inf"), -float("inf")]


def test_bits_keep_the_order_of_doubles(spark):
    rng = np.random.default_rng(1)
    many = [*SPECIAL, *(float(2.0**k) for k in range(-1074, 1024, 37)), *struct.unpack("300d", rng.bytes(2400))]
    values = [v for v in many if v == v]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", qt.ordered_bits(F.col("v")).alias("b")).select("v", "b", qt.from_bits(F.col("b")).alias("back")).collect()
    assert all(r["back"] == r["v"] for r in got)
    in_order = sorted(got, key=lambda r: r["v"])
    assert all(a["b"] < b["b"] or a["v"] == b["v"] and a["b"] == b["b"] for a, b in zip(in_order, in_order[1:], strict=False))
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v double").select(qt.ordered_bits(F.col("v")).alias("b")).collect()
    assert odd[0]["b"] > in_order[-1]["b"] and odd[1]["b"] is None


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(2)
    groups = {"a": rng.normal(size=501) * 1e3, "b": np.repeat([3.0, 3.0, -7.5], 40), "c": np.array([2.0]), "d": rng.integers(-5, 5, 1000).astype(float), "e": 10.0 ** rng.uniform(-200, 200, 300)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("f", None)]
    probabilities = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    found = qt.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", probabilities)
    got = {r["k"]: [r[c] for c in probabilities] for r in found.collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        np.testing.assert_allclose(got[k], np.quantile(vs, list(probabilities.values())), rtol=1e-12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    assert qt.quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", probabilities).count() == 0


def test_thresholds_and_median_scale_do_not_meet_in_one_task(spark):
    rows = [(float(k % 13),) for k in range(400)]
    quads = spark.createDataFrame(rows, "s double").select(*[(F.lit(float(i)) + F.col("s")).cast("float").alias(c) for i, c in enumerate(("c0x", "c0y", "c1x", "c1y", "c2x", "c2y", "c3x", "c3y"))])
    plan = qu.seed_thresholds(quads)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and plan.count("SinglePartition") == 1  # the three rows at the end
    scales = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", None), ("d", 0.2), ("e", 0.5)], "source string, mm_per_px double")
    assert rec.median_scale(scales).first()[0] == pytest.approx(0.25)
    assert np.isnan(rec.median_scale(scales.fillna(float("nan"))).first()[0]) and rec.median_scale(scales.where("source = 'c'")).first()[0] is None


def test_one_run_gives_cells_metrics_and_record(spark, tmp_path):
    d, params = detections(spark), CleanParams(min_detections=20, max_jump=60.0, n_frames=300)
    boxes = boxes_of(spark, [(f, 10 * t + 2, 5 * t) for f in range(0, 300, 2) for t in range(4)])
    run = clean_to(str(tmp_path / "cells"), d, boxes, params, stamp="2020-01-01T00:00:00")
    cells, quality = clean(d, boxes, params)
    assert rows_of(run.cells) == rows_of(cells) and rows_of(run.metrics) == rows_of(quality.select(*run.metrics.columns))
    one = run.metrics.first()
    assert run.totals == {k: one[k] for k in run.totals} and run.totals["yolo_filled_count"] > 0
    attrs = {r["key"]: json.loads(r["value_json"]) for r in run.run_attrs.collect()}
    assert attrs["stage"] == "clean" and attrs["cleaned_utc"] == "2020-01-01T00:00:00" and attrs["box_filled_count"] == one["yolo_filled_count"] and attrs["tag_size_px"] == 10.0
    with pytest.raises(EmptyTrackingError):
        clean_to(str(tmp_path / "none"), d, None, CleanParams(min_detections=10_000, n_frames=300))


def test_records_inherit_and_merge(spark):
    d = detections(spark)
    _, quality = clean(d, None, CleanParams(min_detections=20, n_frames=300))
    from waymark.operators.metrics import pixel_scale

    before = spark.createDataFrame([("s", "version", '"1.2"'), ("s", "camera", '"north"'), ("s", "stage", '"detect"'), ("other", "camera", '"x"')], "source string, key string, value_json string")
    got = {r["key"]: r["value_json"] for r in run_attributes(quality, pixel_scale(d), detected=before).collect()}
    assert got["detect_version"] == '"1.2"' and got["camera"] == '"north"' and got["stage"] == '"clean"' and got["tag_size_px"] == "Infinity" and json.loads(got["tag_size_px"]) == float("inf")
    both = run_attributes(quality, pixel_scale(d)).select("source", "key", F.col("value_json").alias("value"))
    merged = {r["key"]: r for r in rec.merge_attributes(both.unionByName(both.withColumn("source", F.lit("t")).where("key <> 'stage'"))).collect()}
    assert not merged["mm_per_px"]["varies"] and merged["stage"]["varies"]
