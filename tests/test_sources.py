"""Readers, writers, scalar functions, splits and streams."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark import functions as g
from waymark import sources, streaming
from waymark.operators import evaluate as ev
from waymark.operators import recordings as rec
from waymark.operators import sampling as sa


def test_index_specs():
    assert sources.parse_indices("0-2, 7,1") == [0, 1, 2, 7]
    for bad in ("x", "3-1", ","):
        with pytest.raises(ValueError):
            sources.parse_indices(bad)
    with pytest.raises(ValueError):
        sources.parse_indices("4", count=4)
    assert sources.parse_bool("Yes") and not sources.parse_bool("off") and sources.parse_ids("1, 2,") == [1, 2]


def test_names():
    assert sources.is_raw("a_tags", "tags") and not sources.is_raw("a_tags_yolo") and not sources.is_raw(".a")
    assert sources.is_video("x/y.MP4") and not sources.is_video("x/.y.mp4")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 0, 1, float("nan"), 1.5), ("a", 0, 2, 3.0, 2.5)], "source string, frame int, tag_id long, center_x double, c0x double")
    path = str(tmp_path / "tracking/raw_data/v_tags.parquet")
    sources.save(df, path)
    back = sources.load(spark, path)
    assert dict(back.dtypes)["c0x"] == "float" and back.where("center_x IS NULL").count() == 1
    assert sources.load(spark, path, index=-1, corners=False).columns == ["frame", "tag_id", "center_x", "source"]
    assert sources.load(spark, path, index=0).first()["source"] == "a"
    with pytest.raises(IndexError):
        sources.load(spark, path, index=2)
    assert sources.locate(spark, str(tmp_path), "v", "tags") == path


def test_wide_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 1, 1.0), ("a", 0, 2, 2.0), ("a", 1, 1, 3.0)], "source string, frame int, tag_id long, center_x double")
    sources.save_wide_csv(df, str(tmp_path / "c"), [1, 2], ("center_x", "tag_id"))
    got = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert got.count() == 2 and "1_center_x" in got.columns


def test_manifest_and_cover(spark, tmp_path):
    crop = lambda k, ids, kinds: {"crop_idx": k, "crop_file": "f", "bbox_xyxy": [0, 0, 9, 9], "gt_ids": ids, "gt_ass_types": kinds}
    doc = {"video_key": "v", "gt_mode": "clean", "tag_family": "t", "frames": [{"frame_idx": f, "composite_file": "c", "crops": [crop(0, [1], [1]), crop(1, [2, 3], [1, 2])]} for f in range(3)]}
    (tmp_path / "m.json").write_text(json.dumps(doc))
    m = sources.read_manifest(spark, str(tmp_path / "m.json"))
    assert m.count() == 6 and sa.single_label(m.withColumn("experiment", F.lit("e"))).count() == 3
    truth = m.select(F.col("video_key").alias("source"), "frame", "crop_idx", F.explode(F.arrays_zip("gt_ids", "gt_ass_types")).alias("z")).select("source", "frame", "crop_idx", F.col("z.gt_ids").alias("tag_id"), F.col("z.gt_ass_types").alias("ass_type"))
    assert len(ev.cover(truth, 2, 1)) == 2
    assert {r["tag_id"]: r["difficulty"] for r in ev.id_difficulty(truth).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}


def test_presets():
    assert sources.merge_preset({"a": 1, "b": 2}, {"params": {"b": 3}}) == {"a": 1, "b": 3}
    assert json.loads(sources.preset_of_trial({"params_k": 3.0, "params_x": None, "value": 1})) == {"k": 3}


def test_unit_square(spark):
    row = spark.createDataFrame([tuple(float(v) for v in (0, 0, 10, 0, 10, 10, 0, 10))], ", ".join(f"{c} float" for c in g.CORNERS))
    r = row.select(g.quad_area().alias("a"), g.quad_angles().alias("w"), g.side_ratio(g.quad_sides()).alias("r"), g.axis_line(F.lit(1), g.CORNERS, F.lit(20.0), F.lit(20.0)).alias("l")).first()
    assert r["a"] == 100 and r["r"] == 1 and r["w"] == pytest.approx([90] * 4) and r["l"] == "1 0.250000 0.250000 0.500000 0.500000"


def test_scores(spark):
    one = spark.range(1)
    score = lambda a, b, c: one.select(g.yield_score(F.lit(a), F.lit(b), F.lit(c))).first()[0]
    assert score(10, 0, 10) == 1 and score(0, 0, 10) == 0 and score(10, 5, 10) < 1 and score(0, 0, 0) == 0


def test_crop_dataset_is_leak_free(spark):
    rows = [(e, f, c, [10 * (c + 1)], [1 + f % 3]) for e in "abcd" for f in range(30) for c in range(2)]
    crops = spark.createDataFrame(rows, "experiment string, frame int, crop_idx int, gt_ids array<long>, gt_ass_types array<int>")
    d = sa.crop_dataset(crops, 10, 0.25, cap=20).toPandas()
    assert set(d[d.part == "val"].experiment) == {"d"} and set(d[d.part == "val"].ass_type) == {1}
    assert (d[d.part == "train"].groupby("tag_id").size() == 20).all()
    one = sa.crop_dataset(crops.where("experiment = 'a'"), 10, 0.2).toPandas()
    assert one[one.part == "train"].frame.max() < one[one.part == "val"].frame.min()


def test_merged_attributes(spark):
    df = spark.createDataFrame([("b", "k", "1"), ("a", "k", "1"), ("a", "only", "x")], "source string, key string, value string")
    got = {r["key"]: (r["value"], r["values"], r["varies"]) for r in rec.merge_attributes(df).collect()}
    assert got == {"k": ("1", None, False), "only": (None, ["x", None], True)}


def test_streams(spark, tmp_path):
    rows = [("s", f, t, float(f * t), 0.0) for f in range(5) for t in (1, 2)]
    schema = T.StructType.fromDDL("source string, frame int, tag_id long, center_x double, center_y double")
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("frame") * 40)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("steps", streaming.live_steps(stream.drop("ts")), "append"), ("windows", streaming.visible_per_window(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    got = {(r["tag_id"], r["frame"]): r["step"] for r in spark.sql("SELECT * FROM steps").collect()}
    assert got[2, 0] is None and got[2, 3] == 2.0 and got[1, 4] == 1.0
    assert sum(r["n_detections"] for r in spark.sql("SELECT * FROM windows").collect()) == 10


def test_discovery_and_sinks(spark, tmp_path):
    for name in ("a.mp4", ".b.mp4", "sub/c.avi", "t_tags.parquet/x", "t_tags_yolo.parquet/x"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")
    assert [p.rsplit("/", 1)[1] for p in sources.find_videos(spark, str(tmp_path))] == ["a.mp4", "c.avi"]
    assert sources.find_tables(spark, str(tmp_path), "tags") == ["t_tags"]
    sources.save_sidecar(None, "source string, frame int", spark, str(tmp_path / "empty"))
    assert spark.read.parquet(str(tmp_path / "empty")).columns == ["source", "frame"]
    df = spark.range(3)
    assert sources.snapshot(df, str(tmp_path / "snap"), "one").count() == 3 and sources.snapshot(df, None, "one") is df
    lines = spark.createDataFrame([("train", "p1", "0 1"), ("train", "p1", "0 0"), ("val", "p2", "0 2")], "part string, name string, line string")
    sources.write_labels(lines, str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels")).where("name = 'p1'").count() == 2
    (tmp_path / "t.csv").write_text("number,value,params_a\n0,0.5,2\n1,,x\n")
    rows = sources.read_trials(spark, str(tmp_path / "t.csv"), ["a"]).orderBy("number").collect()
    assert rows[0]["params_a"] == 2.0 and rows[1]["value"] is None
    assert ev.top_trials(sources.read_trials(spark, str(tmp_path / "t.csv"), ["a"])).count() == 1


def test_manifest_round_trip(spark, tmp_path):
    rows = [("v", "t", f, c, "x", 0, 0, 9, 9, [c], [1]) for f in range(2) for c in range(3)]
    df = spark.createDataFrame(rows, "video_key string, tag_family string, frame int, crop_idx int, crop_file string, crop_x1 int, crop_y1 int, crop_x2 int, crop_y2 int, gt_ids array<long>, gt_ass_types array<int>")
    sources.write_manifest(df, str(tmp_path / "m"))
    back = sources.read_manifest(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.drop("gt_mode").collect())) == sorted(map(tuple, df.collect()))
    info = ev.manifest_info(back).first()
    assert (info["yield_mode"], info["tag_family"], info["valid_ids"], info["n_crops"]) == (False, "t", [0, 1, 2], 6)
    bare = df.withColumn("gt_ids", F.array().cast("array<bigint>"))
    assert ev.manifest_info(bare.withColumn("gt_mode", F.lit(None).cast("string"))).first()["yield_mode"]
    two = back.unionByName(back.withColumn("tag_family", F.lit("u")).withColumn("gt_mode", F.lit("yolo")))
    info = ev.manifest_info(two).first()
    assert info["yield_mode"] and info["tag_family"] is None
    assert tuple(ev.manifest_totals(two).first()) == (1, 2, 12)
    none = ev.manifest_info(back.where("false")).first()
    assert not none["yield_mode"] and none["valid_ids"] == [] and none["n_crops"] == 0


def test_seeded_split():
    train, val = sa.seeded_split([f"n{k}" for k in range(10)], 0.3)
    assert len(val) == 3 and sorted(train + val) == sorted(f"n{k}" for k in range(10)) and (train, val) == sa.seeded_split([f"n{k}" for k in range(10)], 0.3)


def test_image_kernels():
    import numpy as np

    from waymark.functions import images

    a = np.random.default_rng(42).integers(0, 256, (20, 30), dtype=np.uint8)
    assert (images.invert(images.invert(a)) == a).all() and (abs(images.gamma(a, 1.0).astype(int) - a) <= 1).all()
    for out in (images.tone(a, "sqrt"), images.tone(a, "tuning_log"), images.contrast(a, 2.0), images.sharpen(a)):
        assert out.dtype == np.uint8 and out.shape == a.shape
    flat = np.full((9, 9), 128, np.uint8)
    assert (images.sharpen(flat) == 128).all() and (images.contrast(flat, 3.0) == 128).all()
    assert images.strip(a, [(0, 0, 4, 5), (10, 2, 13, 4)]).shape == (5, 7)


def test_observe_with_fakes(spark):
    import numpy as np

    from waymark.plans.observe import ObserveParams, observe

    image = np.zeros((60, 100), np.uint8)
    image[10:20, 10:20], image[30:40, 60:70] = 200, 90

    def detector(frame):
        assert frame.shape == (60, 100)
        return [(10, 10, 20, 20, 0.9), (11, 10, 20, 20, 0.5), (60, 30, 70, 40, 0.8), (0, 0, 5, 5, 0.01)]

    def decoder(strip):
        ys, xs = np.nonzero(strip == 200)
        square = lambda y, x: [(x.min(), y.min()), (x.max(), y.min()), (x.max(), y.max()), (x.min(), y.max())]
        return [(7, square(ys, xs)), (999, square(ys, xs))], [square(*np.nonzero(strip == 90))]

    frames = spark.createDataFrame([("s", f, bytearray(image.tobytes()), 100, 60) for f in range(2)], "source string, frame int, image binary, width int, height int")
    d, b, q = observe(frames, detector, decoder, ObserveParams())
    assert {(r["frame"], r["tag_id"], r["center_x"], r["center_y"], r["c0x"]) for r in d.collect()} == {(f, 7, 14.5, 14.5, 10.0) for f in range(2)}
    assert sorted((r["frame"], r["decoded"], r["tag_id"]) for r in b.collect()) == [(f, x, t) for f in range(2) for x, t in ((False, -1), (True, 7))]
    assert {(r["center_x"], r["center_y"]) for r in q.collect()} == {(64.5, 34.5)}


def touch(root, *names):
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("")


def test_recordings_by_folder(spark, tmp_path):
    rec_dir = str(tmp_path / "r")
    for k, stem in enumerate(("b", "a")):
        df = spark.createDataFrame([(0, k, 1.0, 2.5)], "frame int, tag_id long, center_x double, c0x double")
        df.write.parquet(f"{rec_dir}/tracking/clean_data/{stem}_tags_clean.parquet")
        df.write.parquet(f"{rec_dir}/tracking/clean_data/.{stem}_tags_clean.parquet")
    got = sources.load_recording(spark, rec_dir, "tags")
    assert sorted((r["source"], r["tag_id"]) for r in got.collect()) == [("a", 1), ("b", 0)]
    assert sources.load_recording(spark, rec_dir, "_tags", video=-1).first()["source"] == "b"
    one = sources.load_recording(spark, f"{rec_dir}/tracking/clean_data/a_tags_clean.parquet", "tags", corners=False)
    assert one.first()["source"] == "a" and "c0x" not in one.columns
    with pytest.raises(IndexError):
        sources.load_recording(spark, rec_dir, "tags", video=2)
    with pytest.raises(FileNotFoundError):
        sources.load_recording(spark, rec_dir, "other")
    assert sources.table_base("x/a.parquet") == "x/a" and sources.table_base("x/a.csv") == "x/a.csv"


def test_corners_of_a_table(spark):
    rows = [(3, *[1.0] * 8), (1, *[1.0] * 8), (3, *[2.0] * 8), (2, *[1.0] * 7, None), (4, *[float("nan")] * 8)]
    df = spark.createDataFrame(rows, "tag_id long, " + ", ".join(f"{c} double" for c in g.CORNERS))
    assert sources.has_corners(df) and not sources.has_corners(df.drop("c2y"))
    assert [r[0] for r in sources.corner_tags(df).collect()] == [1, 3]


def test_experiments(spark, tmp_path):
    touch(tmp_path, "r/v.mp4", "r/tracking/raw_data/v_tags.parquet", "r/tracking/raw_data/v_tags_yolo.parquet", "q/w.mkv", "q/tracking/raw_data/w_a.parquet", "q/tracking/raw_data/w_b.parquet", "none/x.txt")
    r, q = str(tmp_path / "r"), str(tmp_path / "q")
    assert sources.resolve_experiments(spark, [r]) == [("r", f"{r}/v.mp4", f"{r}/tracking/raw_data/v_tags.parquet")]
    assert sources.resolve_experiments(spark, [q], suffix="_b")[0][2].endswith("w_b.parquet")
    assert sources.resolve_experiments(spark, [q], with_tables=False)[0][2] is None
    assert sources.resolve_experiments(spark, [], ["t.parquet:/x/y/z.mp4", ":z.mp4"]) == [("y", "/x/y/z.mp4", "t.parquet"), ("z", "z.mp4", None)]
    for bad in ({}, {"suffix": "_c"}):
        with pytest.raises(ValueError):
            sources.resolve_experiments(spark, [q], **bad)
    with pytest.raises(ValueError):
        sources.resolve_experiments(spark, [str(tmp_path / "none")])
    touch(tmp_path, "sets/b/manifest.json", "sets/a/manifest.json", "sets/c/crops/x.png")
    assert sources.discover_test_sets(spark, str(tmp_path / "sets")) == ["a", "b"]
    w = [f"{tmp_path}/no/m.pt", f"{tmp_path}/r/v.mp4", f"{tmp_path}/r/n.pt"]
    assert sources.first_existing(spark, w) == w[1] and sources.first_existing(spark, w, "given") == "given" and sources.first_existing(spark, w[::2]) == w[2]


def test_image_folders(spark, tmp_path):
    touch(tmp_path, "i/a.PNG", "i/b.jpg", "m/a.png", "m/v.mp4", "e/x.txt")
    assert [sources.is_image_input(spark, str(tmp_path / n)) for n in "ime"] == [True, False, False]
    with pytest.raises(sources.TrackingError):
        sources.read_images(spark, str(tmp_path / "e"))


def test_dataset_and_trial_sinks(spark, tmp_path):
    rows = [("train", "a", 1, 1), ("train", "a", 1, 3), ("train", "b", 2, 1), ("val", "c", 1, 1)]
    doc = sources.write_dataset_manifest(spark.createDataFrame(rows, "part string, experiment string, tag_id long, ass_type int"), str(tmp_path / "d"), {"cap": 5})
    assert doc["n_classes"] == 2 and doc["n_crops"] == {"train": 3, "val": 1} and doc["counts"]["train"] == {"1": 2, "2": 1}
    assert doc["provenance"]["train"] == {"1": 2, "3": 1} and doc["experiments"] == {"train": ["a", "b"], "val": ["c"]}
    assert spark.read.option("header", True).csv(str(tmp_path / "d/manifest")).count() == 4
    assert json.loads(spark.read.text(str(tmp_path / "d/summary"), wholetext=True).first()[0]) == doc
    trials = spark.createDataFrame([(0, 0.5, 2.0, 1.0), (1, None, 3.0, 1.0), (2, 0.5, 4.5, 1.0)], "number int, value double, params_k double, recall double")
    assert sources.write_trials(trials, str(tmp_path / "t"), ("recall",)) == {"score": 0.5, "params": {"k": 2}, "metrics": {"recall": 1.0}}
    assert sources.read_trials(spark, str(tmp_path / "t/trials"), ["k"]).count() == 3
    assert sources.write_trials(trials.where("number = 1"), str(tmp_path / "u")) is None
    sources.write_data_yaml(spark, str(tmp_path / "y"), "/data", ["tag"])
    assert "  0: tag" in spark.read.text(str(tmp_path / "y"), wholetext=True).first()[0]


def test_presets_of_a_folder(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"params": {"k": 1}}')
    assert sources.load_preset(spark, "one", str(tmp_path)) == {"k": 1} == sources.load_preset(spark, str(tmp_path / "one.json"), str(tmp_path))
    with pytest.raises(FileNotFoundError):
        sources.load_preset(spark, "two", str(tmp_path))


def test_colours_repeat():
    a = sources.tag_colors([5, 9])
    assert a == sources.tag_colors([5, 9]) and all(0 <= v < 255 for c in a.values() for v in c)


def test_times_of_composites(spark):
    c = spark.createDataFrame([("s", 2, 3, 1)], "source string, total_composites long, total_with_gt long, total_no_gt long")
    t = spark.createDataFrame([("s", 0.1, 0.2), ("s", 0.1, 0.0)], "source string, preprocess_s double, detect_s double")
    r = ev.with_times(c, t).first()
    assert r["avg_preprocess_ms"] == pytest.approx(100) and r["avg_total_ms"] == pytest.approx(200) and r["avg_time_per_crop_ms"] == pytest.approx(100)


def test_counters_without_rows(spark):
    crops = spark.createDataFrame([("s", 0, 0)], "source string, frame int, crop_idx int")
    ids = crops.withColumn("tag_id", F.lit(1).cast("long"))
    r = ev.testset_counters(crops, ids.where("false"), ids, ids).first()
    assert (r["total_no_gt"], r["no_gt_discoveries"], r["no_gt_hallucinations"], r["detection_rate"]) == (1, 1, 0, 0.0)
    r = ev.testset_counters(crops, ids.where("false"), ids, ids.where("false")).first()
    assert (r["no_gt_discoveries"], r["no_gt_hallucinations"]) == (0, 1)
    assert ev.cover(ids.withColumn("ass_type", F.lit(1)).where("false"), 3, 2) == []


def test_sources_are_named_by_their_folders(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = [(name, 0, 1, 1.0) for name in ("b c", "a:1", "z")]
    sources.save(spark.createDataFrame(rows, "source string, frame int, tag_id long, center_x double"), path)
    assert sources._source_names(spark.read.parquet(path), path) == ["a:1", "b c", "z"]
    assert [r["source"] for r in sources.load(spark, path, 1).collect()] == ["b c"] and [r["source"] for r in sources.load(spark, path, -1).collect()] == ["z"]
    numbered = str(tmp_path / "numbers")
    sources.save(spark.createDataFrame([(n, 0, 1, 1.0) for n in ("10", "9")], "source string, frame int, tag_id long, center_x double"), numbered)
    assert [str(r["source"]) for r in sources.load(spark, numbered, 0).collect()] == ["9"]
    plain = str(tmp_path / "plain")
    spark.createDataFrame(rows, "source string, frame int, tag_id long, center_x double").write.parquet(plain)
    assert [r["source"] for r in sources.load(spark, plain, 0).collect()] == ["a:1"]
    with pytest.raises(IndexError):
        sources.load(spark, path, 3)
