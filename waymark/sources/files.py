"""Data sources of our own: frames of a video, and a folder of files.

``FrameSource`` (format ``waymark_frames``) reads frames of one video.  Filters
on ``frame`` are pushed down; the wanted frames become runs as in
:func:`sampling.read_plan`, a run is a partition, and a reader seeks once a run
and decodes up to its last wanted frame.  Decoders are injected: option
``decoder`` names a callable ``module:name`` that opens a path and returns an
object with ``n_frames``, ``shape``, ``seek``, ``read`` and ``close``.  The one
here reads uncompressed containers.

``FilesSink`` (format ``waymark_files``) writes rows as files.  A task writes
each file beside its place and renames it, so an attempt that fails or runs
twice leaves whole files only; all files appear together when the job commits,
none if it aborts.
"""

from __future__ import annotations

import importlib
import os
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from waymark.operators.sampling import read_plan

_MAGIC, _HEAD = b"WMRAW1\0\0", struct.Struct("<8s4I")
FRAMES = "frame int, image binary, height int, width int, channels int, n_reads int"


class RawVideo:
    """Uncompressed container: a magic number, width, height, channels and number of frames, then the frames' bytes."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        magic, width, height, channels, self.n_frames = _HEAD.unpack(self.file.read(_HEAD.size))
        if magic != _MAGIC:
            raise ValueError(f"not an uncompressed container: {path}")
        self.shape = height, width, channels
        self.size = height * width * channels

    def seek(self, frame: int) -> None:
        self.file.seek(_HEAD.size + frame * self.size)

    def read(self) -> bytes | None:
        """The next frame; None after the last one."""
        data = self.file.read(self.size)
        return data if len(data) == self.size else None

    def close(self) -> None:
        self.file.close()


def write_raw_video(path: str, frames: np.ndarray) -> None:
    """``frames`` (number, height, width, channels) of 8-bit samples as an uncompressed container."""
    n, height, width, channels = frames.shape
    with open(path, "wb") as f:
        f.write(_HEAD.pack(_MAGIC, width, height, channels, n) + np.ascontiguousarray(frames, np.uint8).tobytes())


def opener(name: str | None) -> Callable:
    """The decoder that ``module:name`` stands for."""
    if not name:
        return RawVideo
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def runs(wanted: Iterable[int], seek_gap: int = 30, longest: int = 256) -> list[list[int]]:
    """Sorted distinct frames in runs: a new one over ``seek_gap`` after the last frame, or when a run has ``longest`` frames."""
    out: list[list[int]] = []
    for f in sorted(set(wanted)):
        if not out or f - out[-1][-1] > seek_gap or len(out[-1]) >= longest:
            out.append([])
        out[-1].append(f)
    return out


def decode_run(video, run: list[int]) -> Iterator[tuple]:
    """Rows (``FRAMES``) of a run; ``n_reads`` counts what was decoded for the row. A video that ends early ends the run."""
    video.seek(run[0])
    wanted, n = set(run), 0
    for f in range(run[0], run[-1] + 1):
        data = video.read()
        if data is None:
            return
        n += 1
        if f in wanted:
            yield (f, data, *video.shape, n)
            n = 0


@dataclass
class Run(InputPartition):
    frames: list[int]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.decoder = options["path"], options.get("decoder")
        self.seek_gap, self.longest = int(options.get("seek_gap", 30)), int(options.get("run_frames", 256))
        self.low, self.high, self.named = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Take what narrows ``frame``; the rest is left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("frame",) or not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        if isinstance(f, EqualTo | In):
            values = {v for v in ([f.value] if isinstance(f, EqualTo) else f.value) if v is not None}
            self.named = values if self.named is None else self.named & values
        elif isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, LessThan | LessThanOrEqual):
            high = f.value - isinstance(f, LessThan)
            self.high = high if self.high is None else min(self.high, high)
        else:
            return False
        return True

    def partitions(self) -> list[Run]:
        video = opener(self.decoder)(self.path)
        last = video.n_frames - 1 if self.high is None else min(self.high, video.n_frames - 1)
        video.close()
        wanted = range(self.low, last + 1) if self.named is None else [f for f in self.named if self.low <= f <= last]
        return [Run(r) for r in runs(wanted, self.seek_gap, self.longest)] or [Run([])]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not partition.frames:
            return
        video = opener(self.decoder)(self.path)
        try:
            yield from decode_run(video, partition.frames)
        finally:
            video.close()


class FrameSource(DataSource):
    """Frames of the video at ``path``; options ``decoder``, ``seek_gap`` and ``run_frames``."""

    @classmethod
    def name(cls) -> str:
        return "waymark_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def read_frames(spark: SparkSession, path: str, decoder: str | None = None, seek_gap: int = 30, run_frames: int = 256) -> DataFrame:
    """Frames of one video; filter it by ``frame``, and only those are decoded (and what lies between neighbours)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    reader = spark.read.format("waymark_frames").option("seek_gap", seek_gap).option("run_frames", run_frames)
    return (reader.option("decoder", decoder) if decoder else reader).load(path)


def frame_runs(wanted: DataFrame, seek_gap: int = 30, run_frames: int = 256) -> DataFrame:
    """``wanted`` (source, frame and more) with the run of its video that it belongs to: ``run`` and ``part``, as :func:`runs` has them."""
    w = Window.partitionBy("source").orderBy("frame")
    p = read_plan(wanted, seek_gap).withColumn("run", F.sum(F.col("seek").cast("int")).over(w))
    p = p.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("source", "run").orderBy("frame")) - 1) / run_frames))
    return wanted.join(p.select("source", "frame", "run", "part"), ["source", "frame"])


def map_frames(wanted: DataFrame, videos: DataFrame, work: Callable, schema: str, decoder: str | None = None, seek_gap: int = 30, run_frames: int = 256) -> DataFrame:
    """Rows that ``work`` makes of frames, each read by the task that needs it, so that no pixels are shuffled.

    ``wanted`` has source, frame and what else ``work(source, row, more)`` gets as
    ``more``: ``row`` is a row of ``FRAMES``, ``more`` the list of the other
    columns' values, one tuple a row of that frame.  ``videos`` has source and
    path.  A run of a video is decoded in one task.
    """
    rest = [c for c in wanted.columns if c not in ("source", "frame")]
    of_frame = wanted.groupBy("source", "frame").agg(F.collect_list(F.struct(F.lit(0).alias("_"), *rest)).alias("more"))
    of_run = frame_runs(of_frame, seek_gap, run_frames).groupBy("source", "run", "part").agg(F.collect_list(F.struct("frame", "more")).alias("frames")).join(videos, "source")
    names = [c.split()[0] for c in schema.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for source, path, frames in batch[["source", "path", "frames"]].itertuples(index=False):
                more = {int(f["frame"]): [tuple(m[c] for c in rest) for m in f["more"]] for f in frames}
                video = opener(decoder)(path)
                try:
                    for row in decode_run(video, sorted(more)):
                        made = list(work(source, row, more[row[0]]))
                        if made:
                            yield pd.DataFrame(made, columns=names)
                finally:
                    video.close()

    return of_run.select("source", "path", "frames").repartition("source", F.hash("frames.frame")).mapInPandas(decode, schema)


def frames_of(wanted: DataFrame, videos: DataFrame, decoder: str | None = None, seek_gap: int = 30, run_frames: int = 256) -> DataFrame:
    """Frames of many videos: ``wanted`` (source, frame) of ``videos`` (source, path)."""
    return map_frames(wanted.select("source", "frame").distinct(), videos, lambda source, row, _: [(source, *row)], "source string, " + FRAMES, decoder, seek_gap, run_frames)


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class FilesWriter(DataSourceWriter):
    """Rows (file, content, src_path): ``content``, or if it is null a copy of ``src_path``, under the relative name ``file``.

    Rows of one name are one file.  Any store that pyarrow opens by its address
    will do; links are made on local file systems.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.link = options["path"].rstrip("/"), overwrite, options.get("link", "false").lower() == "true"
        self.staging = f"{self.path}.writing-{uuid.uuid4().hex}"

    def _store(self, path: str) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))

    def write(self, rows: Iterator) -> Written:
        store, root = self._store(self.staging)
        made: set[str] = set()
        files = size = 0
        for row in rows:
            parts = row["file"].split("/")
            if row["file"].startswith("/") or ".." in parts:
                raise ValueError(f"not a name below the folder: {row['file']!r}")
            folder = "/".join([root, *parts[:-1]])
            if folder not in made:  # once a folder, not once a file
                store.create_dir(folder, recursive=True)
                made.add(folder)
            place = f"{root}/{row['file']}"
            beside = f"{place}.{uuid.uuid4().hex}"
            if row["content"] is not None:
                with store.open_output_stream(beside) as f:
                    f.write(bytes(row["content"]))
            elif self.link:
                os.symlink(os.path.abspath(row["src_path"]), beside)
            else:
                self._copy(row["src_path"], store, beside)
            store.move(beside, place)
            files += 1
            size += len(row["content"] or b"")
        return Written(files, size)

    def _copy(self, src: str, store: pafs.FileSystem, to: str) -> None:
        source, path = self._store(src)
        pafs.copy_files(path, to, source_filesystem=source, destination_filesystem=store)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store(self.staging)
        _, target = self._store(self.path)
        store.create_dir(root, recursive=True)  # also a job without rows leaves a folder
        there = store.get_file_info(target).type != pafs.FileType.NotFound
        if there and not self.overwrite:
            store.delete_dir(root)
            raise FileExistsError(self.path)
        if there:
            old = f"{root}-old"
            store.move(target, old)
            store.move(root, target)
            store.delete_dir(old)
        else:
            store.move(root, target)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = self._store(self.staging)
        if store.get_file_info(root).type != pafs.FileType.NotFound:
            store.delete_dir(root)


class FilesSink(DataSource):
    """A folder of files; option ``link`` makes links to ``src_path`` instead of copies."""

    @classmethod
    def name(cls) -> str:
        return "waymark_files"

    def schema(self) -> str:
        return "file string, content binary, src_path string"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(dict(self.options), overwrite)


def write_files(files: DataFrame, path: str, overwrite: bool = False, link: bool = False) -> None:
    """``files`` (file, content, src_path) as a folder that is there whole or not at all; without ``overwrite`` it mustn't exist."""
    files.sparkSession.dataSource.register(FilesSink)
    rows = files.select("file", F.col("content").cast("binary").alias("content"), F.col("src_path").cast("string").alias("src_path"))
    rows.write.format("waymark_files").option("link", str(link).lower()).mode("overwrite" if overwrite else "append").save(path)


def crop_name(suffix: str = ".jpg") -> Column:
    """The name of a crop (experiment, frame, crop_idx) in a data set."""
    return F.format_string("%s_f%06d_c%03d" + suffix, "experiment", "frame", "crop_idx")


def crop_files(records: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """Files of a crop data set: records (part, tag_id, experiment, frame, crop_idx, src_path) under part and class."""
    name = F.concat_ws("/", "part", F.col("tag_id").cast("string"), crop_name(suffix))
    return records.select(name.alias("file"), F.lit(None).cast("binary").alias("content"), "src_path")


def label_files(lines: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """``<part>/labels/<name>.txt`` from label lines (part, name, line, and n if their order counts); ``pictures`` (part, name) without lines get an empty file."""
    rank = F.col("n") if "n" in lines.columns else F.lit(0)
    per = lines.groupBy("part", "name").agg(F.array_sort(F.collect_list(F.struct(rank.alias("n"), "line"))).alias("_l"))
    per = per.select("part", "name", F.concat(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))
    if pictures is not None:
        per = pictures.select("part", "name").distinct().join(per, ["part", "name"], "left").fillna("\n", ["text"])
    return per.select(F.format_string("%s/labels/%s.txt", "part", "name").alias("file"), F.col("text").cast("binary").alias("content"), F.lit(None).cast("string").alias("src_path"))
