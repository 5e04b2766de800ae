"""Frames read by runs, files written whole or not at all, review export, table functions, live matching."""

import json
import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tracking import boxes_of, detections_of
from waymark import functions as g
from waymark.functions import tables
from waymark.operators import sampling as sa
from waymark.operators import trajectory as tr
from waymark.operators import chains
from waymark.operators.lineage import settle
from waymark.plans import review
from waymark.schema import CORNERS, CleanParams
from waymark.sources import files
from waymark.streaming import live_fills


@pytest.fixture(scope="module")
def video(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("video") / "v.raw")
    frames = np.random.default_rng(1).integers(0, 256, (120, 4, 6, 3), dtype=np.uint8)
    files.write_raw_video(path, frames)
    return path, frames


def test_only_wanted_frames_are_decoded(spark, video):
    path, frames = video
    wanted = [3, 5, 6, 40, 41, 100]
    got = files.read_frames(spark, path, seek_gap=10).where(F.col("frame").isin(wanted) & (F.col("frame") < 110)).orderBy("frame").collect()
    assert [r["frame"] for r in got] == wanted and all(bytes(r["image"]) == frames[r["frame"]].tobytes() for r in got)
    assert (got[0]["height"], got[0]["width"], got[0]["channels"]) == (4, 6, 3)
    plan = sa.read_plan(spark.createDataFrame([("v", f) for f in wanted], "source string, frame int"), 10)
    assert sum(r["n_reads"] for r in got) == plan.agg(F.sum("n_reads")).first()[0] == 7  # of 120
    assert files.read_frames(spark, path, seek_gap=10).where(F.col("frame").isin(wanted)).rdd.getNumPartitions() == 3


@pytest.mark.parametrize(("condition", "expected"), [("frame = 7", [7]), ("frame > 117", [118, 119]), ("frame >= 2 AND frame < 4", [2, 3]), ("frame IN (1, 500)", [1]), ("frame = 900", []), ("frame = 3 AND n_reads > 5", [])])
def test_filters_of_frames(spark, video, condition, expected):
    assert sorted(r["frame"] for r in files.read_frames(spark, video[0]).where(condition).collect()) == expected


def test_all_frames_in_runs_and_an_injected_decoder(spark, video):
    every = files.read_frames(spark, video[0], decoder="waymark.sources.files:RawVideo", run_frames=50)
    assert every.count() == 120 and every.rdd.getNumPartitions() == 3
    assert files.runs([1, 2, 40, 41, 42, 90], 30, 2) == [[1, 2], [40, 41], [42], [90]]


def test_frames_of_many_videos(spark, video, tmp_path):
    other = str(tmp_path / "w.raw")
    files.write_raw_video(other, np.zeros((10, 2, 2, 1), np.uint8))
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 90), ("b", 9), ("b", 15), ("c", 0)], "source string, frame int")
    videos = spark.createDataFrame([("a", video[0]), ("b", other)], "source string, path string")
    got = sorted((r["source"], r["frame"], r["n_reads"]) for r in files.frames_of(wanted, videos).collect())
    assert got == [("a", 1, 1), ("a", 2, 1), ("a", 90, 1), ("b", 9, 1)]


def test_videos_are_observed_where_they_are_read(spark, tmp_path):
    from waymark.plans.observe import ObserveParams, observe_videos

    image = np.zeros((60, 100), np.uint8)
    image[10:20, 10:20], image[30:40, 60:70] = 200, 90
    path = str(tmp_path / "v.raw")
    files.write_raw_video(path, np.repeat(image[None, :, :, None], 40, 0).repeat(3, 3))

    def detector(frame):
        assert frame.shape == (60, 100)
        return [(10, 10, 20, 20, 0.9), (11, 10, 20, 20, 0.5), (60, 30, 70, 40, 0.8), (0, 0, 5, 5, 0.01)]

    def decoder(strip):
        square = lambda y, x: [(x.min(), y.min()), (x.max(), y.min()), (x.max(), y.max()), (x.min(), y.max())]
        return [(7, square(*np.nonzero(strip == 200)))], [square(*np.nonzero(strip == 90))]

    wanted = spark.createDataFrame([("v", f) for f in (0, 3, 39, 70)], "source string, frame int")
    d, b, q = observe_videos(spark.createDataFrame([("v", path)], "source string, path string"), wanted, detector, decoder, ObserveParams())
    assert {(r["frame"], r["tag_id"], r["center_x"], r["center_y"], r["c0x"]) for r in d.collect()} == {(f, 7, 14.5, 14.5, 10.0) for f in (0, 3, 39)}
    assert sorted((r["frame"], r["decoded"], r["tag_id"]) for r in b.collect()) == [(f, x, t) for f in (0, 3, 39) for x, t in ((False, -1), (True, 7))]
    assert {(r["center_x"], r["center_y"]) for r in q.collect()} == {(64.5, 34.5)}


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(path) for f in names}


ROWS = [(f"a/{k % 3}/{k}.txt", f"text {k}".encode(), None) for k in range(20)]
FILES = "file string, content binary, src_path string"


def test_files_are_written_together(spark, tmp_path):
    src = tmp_path / "src.jpg"
    src.write_bytes(b"image")
    df = spark.createDataFrame([*ROWS, ("b/copy.jpg", None, str(src))], FILES).repartition(4)
    out = str(tmp_path / "out")
    files.write_files(df, out)
    assert tree(out) == {name: content for name, content, _ in ROWS} | {"b/copy.jpg": b"image"}
    with pytest.raises(Exception, match="out"):
        files.write_files(df, out)
    files.write_files(df.limit(0).unionByName(spark.createDataFrame([("l.jpg", None, str(src))], FILES)), out, overwrite=True, link=True)
    assert os.path.islink(f"{out}/l.jpg") and tree(out) == {"l.jpg": b"image"} and [p for p in os.listdir(tmp_path) if "writing" in p] == []


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([*ROWS, ("../outside", b"x", None)], FILES).repartition(3)
    with pytest.raises(Exception, match="below the folder"):
        files.write_files(bad, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []


RETRY = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from waymark.sources import files
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()

def once(batches):
    for batch in batches:
        for k in range(len(batch)):
            yield batch.iloc[k : k + 1]
            if k == 5 and TaskContext.get().attemptNumber() == 0:
                raise RuntimeError("first attempt")

rows = spark.range(0, 40, 1, 2).selectExpr("concat('d/', id, '.txt') AS file", "cast(concat('t', id) AS binary) AS content", "cast(null AS string) AS src_path")
files.write_files(rows.mapInPandas(once, "file string, content binary, src_path string"), {out!r})
"""


def test_a_failing_first_attempt(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = str(tmp_path / "out")
    done = subprocess.run([sys.executable, "-c", RETRY.format(root=root, out=out)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "first attempt" in done.stderr
    assert tree(out) == {f"d/{k}.txt": f"t{k}".encode() for k in range(40)} and os.listdir(tmp_path) == ["out"]


def test_crop_and_label_files(spark):
    records = spark.createDataFrame([("train", 7, "e1", 12, 3, "/x/y.jpg")], "part string, tag_id long, experiment string, frame int, crop_idx int, src_path string")
    assert tuple(files.crop_files(records).first()) == ("train/7/e1_f000012_c003.jpg", None, "/x/y.jpg")
    lines = spark.createDataFrame([("val", "p", 2, "b"), ("val", "p", 10, "a")], "part string, name string, n long, line string")
    got = {r["file"]: bytes(r["content"]) for r in files.label_files(lines, spark.createDataFrame([("val", "p"), ("train", "q")], "part string, name string")).collect()}
    assert got == {"val/labels/p.txt": b"b\na\n", "train/labels/q.txt": b"\n"}


LIMITS = {"area_min": 50.0, "area_max": 200.0, "angle_min": 70.0, "angle_max": 110.0, "side_min": 5.0, "side_max": 15.0, "ratio_min": 0.6, "dedup_px": 1.0}


def reviewed(spark):
    quads = [(e, f, k, *[float(v) for v in (x, 10, x + s, 10, x + s, 10 + s, x, 10 + s)]) for e in ("e1", "e2") for f in (1, 2, 3) for k, (x, s) in enumerate([(0, 10), (30, 10), (60, 30)])]
    candidates = spark.createDataFrame(quads, "experiment string, frame int, quad_id long, " + ", ".join(f"{c} double" for c in CORNERS))
    experiments = spark.createDataFrame([("e1", 100, 50), ("e2", 200, 50)], "experiment string, width int, height int")
    session = {"frames": {"1": {"status": "accepted", "overrides": {"0": "exclude", "2": "include"}}, "2": {"status": "rejected"}, "3": {"status": "accepted"}, "4": {"status": "accepted"}}}
    return candidates, experiments, spark.createDataFrame([(json.dumps(session),), ("no json",), (None,)], "value string")


def test_decisions_are_not_copied_to_experiments(spark):
    candidates, experiments, sessions = reviewed(spark)
    decided = review.decisions(sessions)
    kept = review.kept_quads(candidates, review.accepted_pictures(experiments, decided, review.by_names(0.34)), decided, LIMITS)
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 3  # experiments with frames, quads with pictures, quads with decisions


def test_review_export(spark, tmp_path):
    candidates, experiments, sessions = reviewed(spark)
    decided = review.decisions(sessions)
    assert {(r["frame"], r["status"]) for r in decided.collect()} == {(1, "accepted"), (2, "rejected"), (3, "accepted"), (4, "accepted")}
    assert {(r["frame"], r["quad_id"], r["choice"]) for r in review.override_rows(decided).collect()} == {(1, 0, "exclude"), (1, 2, "include")}
    out = str(tmp_path / "dataset")
    files.write_files(review.review_export(candidates, experiments, decided, LIMITS, review.by_names(0.34), json=True), out)
    got = tree(out)
    names = [f"{e}_{f:06d}" for e in ("e1", "e2") for f in (1, 3, 4)]
    order = sorted(names)
    random.Random(0).shuffle(order)
    val = set(order[: round(6 * 0.34)])
    part = lambda n: "val" if n in val else "train"
    assert set(got) == {f"{part(n)}/labels/{n}.txt" for n in names} | {f"{part(n)}/images/{n}.json" for n in names}
    box = lambda x, s, w: "0 " + " ".join(f"{v:.6f}" for px, py in ((x, 10), (x + s, 10), (x + s, 10 + s), (x, 10 + s)) for v in (px / w, py / 50))
    assert got[f"{part('e1_000001')}/labels/e1_000001.txt"].decode() == box(30, 10, 100) + "\n" + box(60, 30, 100) + "\n"
    assert got[f"{part('e2_000003')}/labels/e2_000003.txt"].decode() == box(0, 10, 200) + "\n" + box(30, 10, 200) + "\n"
    assert got[f"{part('e2_000004')}/labels/e2_000004.txt"] == b"\n"
    doc = json.loads(got[f"{part('e2_000003')}/images/e2_000003.json"])
    assert doc["imageWidth"] == 200 and doc["imageData"] is None and doc["flags"] == {} and [s["points"][0] for s in doc["shapes"]] == [[0.0, 10.0], [30.0, 10.0]]
    assert doc["shapes"][0]["shape_type"] == "rotation" and doc["shapes"][0]["direction"] == 0.0 and doc["shapes"][0]["group_id"] is None
    axis = review.review_export(candidates, experiments, decided, LIMITS, review.by_names(0.0), oriented=False, images="/img/%s/frame_%06d.jpg").collect()
    assert {r["src_path"] for r in axis if r["src_path"]} == {f"/img/{e}/frame_{f:06d}.jpg" for e in ("e1", "e2") for f in (1, 3, 4)}
    assert bytes(next(r for r in axis if r["file"] == "train/labels/e1_000003.txt")["content"]).decode().splitlines()[0] == "0 0.050000 0.300000 0.100000 0.200000"
    assert g.__name__


def test_table_functions_in_lateral_joins(spark):
    tables.register(spark)
    spark.createDataFrame([("a", "0-2,7", 8), ("b", "9", 8), ("c", None, 8), ("d", "x", 8)], "name string, spec string, n int").createOrReplaceTempView("specs")
    got = sorted((r["name"], r["idx"], r["error"] is None) for r in spark.sql("SELECT name, i.* FROM specs, LATERAL index_spec(spec, n) i").collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("a", 7, True), ("b", None, False), ("d", None, False)]
    preset = json.dumps({"a": 1, "b": {"c": 2.5, "on": True}, "name": "x", "list": [1]})
    rows = spark.sql(f"SELECT * FROM preset_entries('{preset}')").collect()
    assert sorted((r["key"], r["number"], r["word"]) for r in rows) == [("a", 1.0, None), ("b.c", 2.5, None), ("b.on", None, "true"), ("list", None, "[1]"), ("name", None, "x")]
    assert spark.sql("SELECT * FROM preset_entries('[1]')").count() == 0
    with pytest.raises(Exception, match="wants text"):
        spark.sql("SELECT * FROM index_spec(5)").collect()


def test_views_and_functions_join_in_sql(spark):
    d = detections_of(spark, [(f, t, 10 * t + f % 3, 5.0) for t in (1, 2) for f in range(0, 60, 1 + t)])
    tables.publish(spark, d, None, CleanParams(min_detections=5, n_frames=60, interp_limit=1))
    got = spark.sql("""
        SELECT m.source, waymark_provenance(t.ass_type) AS kind, count(*) AS n, max(v.n_visible) AS most
        FROM waymark_metrics m, LATERAL waymark_track(m.source, 2) t JOIN waymark_visible('s', 0, 30) v ON v.frame = t.frame
        GROUP BY ALL ORDER BY kind""").collect()
    assert [(r["kind"], r["n"]) for r in got] == [("interpolated", 20), ("original", 11)] and got[0]["most"] == 2
    assert spark.sql("SELECT count(*) FROM waymark_cells c JOIN waymark_gaps g USING (source, tag_id)").first()[0] == 0
    plan = spark.sql("SELECT frame FROM waymark_track('s', 2)")._jdf.queryExecution().optimizedPlan().toString()
    assert "c3y" not in plan.split("LogicalRDD")[0]  # columns are pruned through the view


@pytest.mark.parametrize("limit", [0, 2])
def test_live_fills_are_the_forward_pass(spark, tmp_path, limit):
    rng = np.random.default_rng(3)
    seen, boxes = [], []
    for t in range(4):
        x = np.cumsum(rng.normal(0, 2, 90)) + 8 * t
        for f in range(90):
            if rng.random() < 0.3:
                seen.append((f, t, float(x[f]), 0.0))
            if rng.random() < 0.4:
                boxes.append((f, float(x[f] + 1), 1.0))
    d, b = detections_of(spark, seen), boxes_of(spark, boxes)
    cells = settle(tr.stamp_original(tr.dense_grid(tr.resolve_duplicates(d), 90)).withColumn("reach", F.lit(9.0)))
    want = sorted((r["pos"], r["tag_id"], r["box_id"], round(r["distance"], 9)) for r in chains.chain_pass(cells, settle(b), "forward", 6, limit).collect())
    ts = F.timestamp_millis((F.col("frame").cast("long") + 1) * 100_000)
    events = d.select("source", "frame", ts.alias("ts"), F.lit(False).alias("is_box"), F.col("tag_id").alias("id"), "center_x", "center_y").unionByName(
        b.select("source", "frame", ts.alias("ts"), F.lit(True).alias("is_box"), F.col("box_id").alias("id"), "center_x", "center_y"))
    for k, low in enumerate(range(0, 90, 30)):
        events.where((F.col("frame") >= low) & (F.col("frame") < low + 30)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    events.limit(1).withColumn("ts", F.timestamp_millis(F.lit(10**9))).withColumn("source", F.lit("end")).coalesce(1).write.parquet(str(tmp_path / "in/9"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
        query = live_fills(stream, 9.0, 6, limit).writeStream.format("memory").queryName(f"live{limit}").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(240)
    finally:
        spark.conf.unset(provider)
    got = sorted((r["frame"], r["tag_id"], r["box_id"], round(r["distance"], 9)) for r in spark.table(f"live{limit}").collect())
    assert got == want and len(want) > 20
