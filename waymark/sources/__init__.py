"""Readers and writers of recordings.

A recording is a folder of Parquet tables under ``tracking/raw_data`` and
``tracking/clean_data``, partitioned by ``source``; sidecars end in ``_yolo``
and ``_quads``.  NaN becomes null on the way in.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.schema import CORNERS, TrackingError

VIDEO_SUFFIXES = (".mp4", ".avi", ".mkv", ".mov", ".m4v")
SIDECARS = ("_yolo", "_quads", "_clean")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
#: Table formats by their endings, in the order in which they are looked for.
TABLE_SUFFIXES = (".parquet", ".zst.parquet")


def parse_indices(spec: str, count: int | None = None) -> list[int]:
    """Sorted distinct numbers of a spec such as ``0-4,10``; with ``count`` they must be below it."""
    found: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"not an index or range: {part!r}")
        found.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    if not found:
        raise ValueError("no indices given")
    if count is not None and max(found) >= count:
        raise ValueError(f"indices end at {count - 1}, not {max(found)}")
    return sorted(found)


def parse_bool(text: str) -> bool:
    word = text.strip().lower()
    if word in ("true", "1", "yes", "on"):
        return True
    if word in ("false", "0", "no", "off"):
        return False
    raise ValueError(f"not a truth value: {text!r}")


def parse_ids(text: str) -> list[int]:
    return [int(x) for x in text.split(",") if x.strip()]


def dataname(name: str) -> str:
    return name if name.startswith("_") else f"_{name}"


def table_base(path: str) -> str:
    """A table's path without its ending; other paths stay as they are."""
    return next((path.removesuffix(s) for s in sorted(TABLE_SUFFIXES, key=len, reverse=True) if path.endswith(s)), path)


def is_raw(name: str, suffix: str | None = None) -> bool:
    """Whether a table's base name is a raw one (with that data name)."""
    return not name.startswith(".") and not name.endswith(SIDECARS) and (suffix is None or name.endswith(dataname(suffix)))


def is_video(path: str) -> bool:
    p = PurePosixPath(path)
    return p.suffix.lower() in VIDEO_SUFFIXES and not p.name.startswith(".")


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads, sorted, hidden ones left out."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(target):
        return []
    return sorted(n for n in (s.getPath().getName() for s in store.listStatus(target)) if not n.startswith((".", "_SUCCESS")))


def locate(spark: SparkSession, recording: str, stem: str, name: str) -> str:
    """The table of a video: cleaned, else raw, else beside the video."""
    base = stem + dataname(name)
    for folder, table in ((f"{recording}/tracking/clean_data", base + "_clean"), (f"{recording}/tracking/raw_data", base), (recording, base)):
        if f"{table}.parquet" in list_folder(spark, folder):
            return f"{folder}/{table}.parquet"
    raise TrackingError(f"no table of {stem} in {recording}")


def nulls_for_nan(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def _source_names(df: DataFrame, path: str) -> list:
    """The sources of a table in order: from the names of its folders if it is partitioned by source, else by reading that column."""
    folders = [n.removeprefix("source=") for n in list_folder(df.sparkSession, path) if n.startswith("source=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")]
    if not folders:
        return sorted(r["source"] for r in df.select("source").where("source IS NOT NULL").distinct().collect())
    numbers = dict(df.dtypes)["source"] in ("int", "bigint")
    return sorted(int(n) if numbers else unquote(n) for n in folders)


def load(spark: SparkSession, path: str, index: int | None = None, corners: bool = True) -> DataFrame:
    """A table, of all sources or the one at a (also negative) place in name order; without corners if so asked."""
    df = spark.read.parquet(path)
    if not corners:
        df = df.drop(*CORNERS)
    if index is not None:
        names = _source_names(df, path)
        if not -len(names) <= index < len(names):
            raise IndexError(f"there are {len(names)} sources, not one at {index}")
        df = df.where(F.col("source") == names[index])
    return nulls_for_nan(df)


def load_recording(spark: SparkSession, path: str, name: str, video: int | None = None, corners: bool = True) -> DataFrame:
    """Cleaned cells of a recording's folder (or of one ``..._clean.parquet`` table), all its videos or the one at a place.

    The videos are those with a table of that data name under
    ``tracking/clean_data``, in name order, hidden files left out; ``source``
    names them.  Only the tables asked for are read; which these are is found by
    listing the folder, not by reading.
    """
    ending = f"{dataname(name)}_clean.parquet"
    if path.endswith(".parquet"):
        found = [path]
    else:
        folder = f"{path.rstrip('/')}/tracking/clean_data"
        found = [f"{folder}/{n}" for n in list_folder(spark, folder) if n.endswith(ending)]
    if not found:
        raise FileNotFoundError(f"no table ending in {ending} under {path}")
    if video is not None:
        if not -len(found) <= video < len(found):
            raise IndexError(f"there are {len(found)} videos, not one at {video}")
        found = [found[video]]
    parts = []
    for p in found:
        df = spark.read.parquet(p)
        stem = PurePosixPath(p).name.removesuffix(ending) if p.endswith(ending) else table_base(PurePosixPath(p).name)
        parts.append((df if corners else df.drop(*CORNERS)).withColumn("source", F.lit(stem)))
    return nulls_for_nan(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def has_corners(df: DataFrame) -> bool:
    return all(c in df.columns for c in CORNERS)


def corner_tags(df: DataFrame) -> DataFrame:
    """Ids that have all corners somewhere, in order."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in CORNERS])
    return df.where(whole).select("tag_id").distinct().orderBy("tag_id")


def save(df: DataFrame, path: str) -> None:
    """Corners as 32-bit floats, zstd, partitioned by source."""
    narrow = df.withColumns({c: F.col(c).cast("float") for c in CORNERS if c in df.columns})
    narrow.write.mode("overwrite").option("compression", "zstd").partitionBy("source").parquet(path)


def save_wide_csv(cells: DataFrame, path: str, tags: list[int], metrics: tuple[str, ...] = ("center_x", "center_y", "ass_type", "distance")) -> None:
    """One row a frame, columns ``tag_metric``; the tags are named, as the width depends on them."""
    wide = cells.groupBy("source", "frame").pivot("tag_id", tags).agg(*[F.first(m).alias(m) for m in metrics])
    wide.repartitionByRange("source", "frame").sortWithinPartitions("source", "frame").write.mode("overwrite").option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Crops of test-set manifests, one row each: video_key, tag_family, gt_mode, frame, crop_idx, bounds, gt_ids, gt_ass_types."""
    schema = "video_key string, gt_mode string, tag_family string, frames array<struct<frame_idx:int,composite_file:string,crops:array<struct<crop_idx:int,crop_file:string,bbox_xyxy:array<int>,gt_ids:array<bigint>,gt_ass_types:array<int>>>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    keys = ["video_key", "tag_family", "gt_mode"]
    frames = doc.select(*keys, F.explode("frames").alias("f"))
    c = frames.select(*keys, F.col("f.frame_idx").alias("frame"), F.explode("f.crops").alias("c"))
    bounds = [F.get("c.bbox_xyxy", F.lit(k)).alias(f"crop_{n}") for k, n in enumerate(("x1", "y1", "x2", "y2"))]
    return c.select(*keys, "frame", "c.crop_idx", "c.crop_file", *bounds, "c.gt_ids", "c.gt_ass_types")


def merge_preset(base: dict, preset: dict) -> dict:
    """Settings with a preset's own over them; a preset may hold them under ``params``."""
    return base | preset.get("params", preset)


def find_presets(spark: SparkSession, folder: str) -> dict[str, str]:
    """Paths of a folder's presets (JSON) by name."""
    return {n.removesuffix(".json"): f"{folder}/{n}" for n in list_folder(spark, folder) if n.endswith(".json")}


def load_preset(spark: SparkSession, name: str, folder: str) -> dict:
    """A preset's settings, by its name in the folder or by path."""
    known = find_presets(spark, folder)
    path = known.get(name, name)
    if path == name and not name.endswith(".json"):
        raise FileNotFoundError(f"no preset {name!r}; there are {', '.join(known) or 'none'}")
    return merge_preset({}, json.loads(spark.read.text(path, wholetext=True).first()["value"]))


def preset_of_trial(row: dict) -> str:
    """A trial's ``params_*`` as preset JSON: nulls left out, whole floats as integers."""
    values = {k.removeprefix("params_"): v for k, v in row.items() if k.startswith("params_") and v is not None and v == v}
    return json.dumps({k: int(v) if isinstance(v, float) and v.is_integer() else v for k, v in sorted(values.items())})


def find_tables(spark: SparkSession, folder: str, suffix: str | None = None) -> list[str]:
    """Raw tables of a folder, by base name."""
    names = (n.removesuffix(".parquet") for n in list_folder(spark, folder) if n.endswith(".parquet"))
    return [n for n in names if is_raw(n, suffix)]


def find_videos(spark: SparkSession, path: str) -> list[str]:
    """Videos of a folder and of its folders, one level down; or the one that the path names."""
    if is_video(path):
        return [path]
    found = []
    for name in list_folder(spark, path):
        below = [f"{path}/{name}"] if is_video(name) else [f"{path}/{name}/{n}" for n in list_folder(spark, f"{path}/{name}") if is_video(n)] if "." not in name else []
        found += below
    return found


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded images of a folder: source (its stem), path and content; an error if there are none."""
    if not any(n.lower().endswith(IMAGE_SUFFIXES) for n in list_folder(spark, folder)):
        raise TrackingError(f"no images in {folder}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,tif,tiff,bmp}").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("source"), "path", "content")


def is_image_input(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds images and no videos."""
    names = list_folder(spark, folder)
    return any(n.lower().endswith(IMAGE_SUFFIXES) for n in names) and not any(map(is_video, names))


def discover_test_sets(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders below that hold a manifest; a run that was stopped leaves none."""
    return [n for n in list_folder(spark, folder) if "manifest.json" in list_folder(spark, f"{folder}/{n}")]


def video_tables(spark: SparkSession, video: str) -> list[str]:
    """Raw tables of a video in its recording."""
    v = PurePosixPath(video)
    folder = f"{video.rsplit('/', 1)[0]}/tracking/raw_data"
    return [f"{folder}/{n}.parquet" for n in find_tables(spark, folder) if n.startswith(v.stem)]


def pick_table(tables: list[str], suffix: str | None = None) -> str | None:
    """The one table, or the one whose name has ``suffix``; none if there are none, an error if that leaves a choice."""
    if len(tables) < 2:
        return tables[0] if tables else None
    names = [table_base(PurePosixPath(t).name) for t in tables]
    fit = [t for t, n in zip(tables, names, strict=True) if suffix and suffix in n]
    if len(fit) != 1:
        raise ValueError(f"{len(fit) if suffix else len(tables)} tables fit, give a suffix that only one has: {', '.join(names)}")
    return fit[0]


def resolve_experiments(spark: SparkSession, recordings: list[str], explicit: list[str] = (), suffix: str | None = None, with_tables: bool = True) -> list[tuple[str, str, str | None]]:
    """(name, video, table) of ``table:video`` specs, named by the video's folder, and of recordings by their first video."""
    found = []
    for spec in explicit:
        table, _, video = spec.partition(":")
        folder = PurePosixPath(video).parent.name
        found.append((folder or PurePosixPath(video).stem, video, table if table and with_tables else None))
    for recording in recordings:
        videos = [n for n in list_folder(spark, recording) if is_video(n)]
        if not videos:
            raise ValueError(f"no video in {recording}")
        video = f"{recording.rstrip('/')}/{videos[0]}"
        found.append((PurePosixPath(recording).name, video, pick_table(video_tables(spark, video), suffix) if with_tables else None))
    return found


def first_existing(spark: SparkSession, candidates: list[str], given: str | None = None) -> str:
    """``given`` if set, else the first candidate that exists, else the second (the first if alone), for errors to name."""
    if given:
        return given
    for c in candidates:
        folder, _, name = c.rpartition("/")
        if name in list_folder(spark, folder or "."):
            return c
    return candidates[min(1, len(candidates) - 1)]


#: Blue, green and red of the colours that have names.
COLORS = {
    "red": (0, 0, 255), "green": (0, 255, 0), "blue": (255, 0, 0), "yellow": (0, 255, 255),
    "cyan": (255, 255, 0), "magenta": (255, 0, 255), "white": (255, 255, 255), "black": (0, 0, 0),
}


def parse_color(text: str) -> tuple[int, int, int]:
    """Blue, green and red of a named colour or of ``R,G,B`` from 0 to 255."""
    word = text.strip().lower()
    if word in COLORS:
        return COLORS[word]
    m = re.fullmatch(r"\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*,\s*([+-]?\d+)\s*", text)
    if not m:
        raise ValueError(f"neither a named colour nor R,G,B: {text!r}")
    channels = tuple(int(x) for x in reversed(m.groups()))
    if not all(0 <= c <= 255 for c in channels):
        raise ValueError(f"channels go from 0 to 255: {text!r}")
    return channels


def tag_colors(tags: list[int], seed: int = 42) -> dict[int, tuple[int, int, int]]:
    """A colour for each tag in the order given, the same at each run."""
    rng = np.random.default_rng(seed)
    return {t: tuple(int(c) for c in rng.integers(0, 255, 3)) for t in tags}


def save_sidecar(df: DataFrame | None, schema, spark: SparkSession, path: str) -> None:
    """A sidecar table; its columns are there even if nothing was found."""
    (spark.createDataFrame([], schema) if df is None else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def snapshot(df: DataFrame, folder: str | None, label: str) -> DataFrame:
    """Write a plan's state for debugging, if there is a folder, and go on from what was written."""
    if not folder:
        return df
    df.write.mode("overwrite").parquet(f"{folder}/{label}.parquet")
    return df.sparkSession.read.parquet(f"{folder}/{label}.parquet")


def write_manifest(crops: DataFrame, path: str) -> None:
    """One JSON document a video (video_key, tag_family, and gt_mode if there): its frames with their crops."""
    crop = F.struct("crop_idx", "crop_file", F.array("crop_x1", "crop_y1", "crop_x2", "crop_y2").alias("bbox_xyxy"), "gt_ids", "gt_ass_types")
    keys = [c for c in ("video_key", "tag_family", "gt_mode") if c in crops.columns]
    frames = crops.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(crop)).alias("crops"))
    frame = F.struct(F.col("frame").alias("frame_idx"), "crops")
    frames.groupBy(*keys).agg(F.array_sort(F.collect_list(frame)).alias("frames")).write.mode("overwrite").json(path)


def write_dataset_manifest(records: DataFrame, path: str, params: dict | None = None) -> dict:
    """A data set's records (part, experiment, tag_id, ass_type ..) as CSV, with a JSON summary, which is returned.

    The summary has a count for each part, class, provenance and experiment, so
    its size doesn't grow with the records.
    """
    records.write.mode("overwrite").option("header", True).csv(f"{path}/manifest")
    n = records.groupBy("part", "tag_id", "ass_type").agg(F.count("*").alias("n")).collect()
    sums: dict = {"n_crops": {}, "counts": {}, "provenance": {}}
    for r in n:
        sums["n_crops"][r["part"]] = sums["n_crops"].get(r["part"], 0) + r["n"]
        for kind, key in (("counts", "tag_id"), ("provenance", "ass_type")):
            of = sums[kind].setdefault(r["part"], {})
            of[str(r[key])] = of.get(str(r[key]), 0) + r["n"]
    names = sorted((r["part"], r["experiment"]) for r in records.select("part", "experiment").distinct().collect())
    doc = {"n_classes": len({r["tag_id"] for r in n}), **sums, "experiments": {p: [e for q, e in names if q == p] for p in sums["n_crops"]}, "params": params or {}}
    _write_text(records.sparkSession, json.dumps(doc, indent=2, sort_keys=True), f"{path}/summary")
    return doc


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_data_yaml(spark: SparkSession, path: str, root: str, names: list[str]) -> None:
    """The description that detector training reads: folders and class names."""
    classes = "".join(f"\n  {k}: {n}" for k, n in enumerate(names))
    _write_text(spark, f"path: {root}\ntrain: images/train\nval: images/val\nnames:{classes}", path)


def write_trials(trials: DataFrame, path: str, metrics: tuple[str, ...] = ()) -> dict | None:
    """All trials as CSV in order of their number, and the best one's score, params and metrics as JSON, which are returned."""
    trials.orderBy("number").coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/trials")
    best = trials.where("value IS NOT NULL").orderBy(F.col("value").desc(), "number").first()
    if best is None:
        return None
    row = best.asDict()
    doc = {"score": row["value"], "params": json.loads(preset_of_trial(row)), "metrics": {m: row[m] for m in metrics}}
    _write_text(trials.sparkSession, json.dumps(doc, indent=2, sort_keys=True), f"{path}/best_params")
    return doc


def write_labels(lines: DataFrame, path: str) -> None:
    """Label lines (part, name, line): a text file a picture, under ``part=.../name=...``."""
    per = lines.groupBy("part", "name").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("value"))
    per.repartition("part", "name").write.mode("overwrite").partitionBy("part", "name").text(path)


def read_trials(spark: SparkSession, path: str, parameters: list[str]) -> DataFrame:
    """Trials: number, value and the named ``params_*`` as numbers where they are."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("number").cast("int"), F.expr("try_cast(value AS DOUBLE)").alias("value"), *[F.expr(f"try_cast(`params_{p}` AS DOUBLE)").alias(f"params_{p}") for p in parameters])
