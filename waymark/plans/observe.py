"""From frames to detections, boxes and quads, with detector and decoder given.

``detector(image) -> [(x1, y1, x2, y2, confidence)]`` sees a grey frame;
``decoder(strip) -> ([(tag_id, corners)], [corners])`` sees the enhanced strip of
crops and returns decodes and all quads, corners as four (x, y) in the strip.
Both are called inside tasks; all else is joins and filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import images
from waymark.operators import boxes as bx
from waymark.operators.lineage import settle
from waymark.schema import CORNERS
from waymark.sources import files


@dataclass(frozen=True)
class ObserveParams:
    """Settings of the observation plan."""

    confidence: float = 0.1
    pad_ratio: float = 0.34
    iou: float = 0.4
    max_offset_ratio: float = 0.6
    max_tag_id: int = 237
    silenced: tuple[int, ...] = ()
    enhance: dict = field(default_factory=dict)


_BOX = "source string, frame int, box_id long, box_x1 double, box_y1 double, box_x2 double, box_y2 double, center_x double, center_y double, confidence double, decoded boolean, tag_id long, class_id int"
_DECODE = "source string, frame int, decode_idx long, tag_id long, cx double, cy double, " + ", ".join(f"{c} double" for c in CORNERS)


def _image(row) -> np.ndarray:
    return np.frombuffer(row.image, np.uint8).reshape(row.height, row.width)


def _found_boxes(source: str, frame: int, image: np.ndarray, detector: Callable) -> list[tuple]:
    return [(source, frame, (frame << 20) + k, x1, y1, x2, y2, (x1 + x2) / 2, (y1 + y2) / 2, c, False, -1, 0) for k, (x1, y1, x2, y2, c) in enumerate(detector(image))]


def _found_tags(source: str, frame: int, image: np.ndarray, crops: list[tuple], decoder: Callable, params: ObserveParams) -> list[tuple]:
    """Decodes of the strip of ``crops`` (box_id, x1, y1, x2, y2), and with tag_id -1 all quads."""
    strip = images.strip(image, [c[1:] for c in sorted(crops)])
    tags, quads = decoder(images.enhance(strip, params.enhance))
    rows = []
    for k, (tag, corners) in enumerate([*tags, *((-1, q) for q in quads)]):
        c = np.asarray(corners, float)
        rows.append((source, frame, (frame << 20) + k, tag, *c.mean(0), *c.ravel()))
    return rows


def detect_boxes(frames: DataFrame, detector: Callable, params: ObserveParams = ObserveParams()) -> DataFrame:
    """Boxes of frames (source, frame, image, width, height), after confidence and suppression."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _BOX.split(", ")]
        for batch in batches:
            rows = [b for r in batch.itertuples(index=False) for b in _found_boxes(r.source, r.frame, _image(r), detector)]
            yield pd.DataFrame(rows, columns=names)

    return bx.suppress(bx.confident(frames.mapInPandas(kernel, _BOX), params.confidence), params.iou)


_CROP = ["box_id", "crop_x1", "crop_y1", "crop_x2", "crop_y2"]


def decode_strips(frames: DataFrame, layout: DataFrame, decoder: Callable, params: ObserveParams) -> DataFrame:
    """Decodes (and, with tag_id -1, all quads) of each frame's strip, in strip coordinates.

    Frames meet their crops in a shuffle; :func:`observe_videos` does without.
    """
    names = [c.split()[0] for c in _DECODE.split(", ")]

    def kernel(frame_rows: pd.DataFrame, crop_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(frame_rows) or not len(crop_rows):
            return pd.DataFrame(columns=names)
        r = next(frame_rows.itertuples(index=False))
        rows = _found_tags(r.source, r.frame, _image(r), list(crop_rows[_CROP].itertuples(index=False, name=None)), decoder, params)
        return pd.DataFrame(rows, columns=names)

    key = ["source", "frame"]
    return frames.groupBy(*key).cogroup(layout.groupBy(*key)).applyInPandas(kernel, _DECODE)


def observe(frames: DataFrame, detector: Callable, decoder: Callable, params: ObserveParams = ObserveParams()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detections, boxes (with ``decoded``) and lone quads of undecoded boxes."""
    size = frames.select("source", "frame", "width", "height")
    boxes = detect_boxes(frames, detector, params)
    return _observed(boxes, size, ["source", "frame"], lambda layout: decode_strips(frames, layout, decoder, params), params)


def _grey(row: tuple) -> np.ndarray:
    """The grey image of a row of ``FRAMES``; colours (blue, green, red) are weighed as usual."""
    _, data, height, width, channels, _ = row
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels < 3:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def observe_videos(
    videos: DataFrame, wanted: DataFrame, detector: Callable, decoder: Callable, params: ObserveParams = ObserveParams(), video: str | None = None, seek_gap: int = 30, run_frames: int = 256,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`observe`, of the ``wanted`` frames (source, frame) of ``videos`` (source, path).

    Tasks read the frames themselves, once to detect and once to decode those
    with boxes: crops travel to the frames, pixels nowhere.  ``video`` names the
    opener of a path (``module:name``).
    """

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for source, path in batch[["source", "path"]].itertuples(index=False):
                v = files.opener(video)(path)
                rows.append((source, v.shape[1], v.shape[0]))
                v.close()
            yield pd.DataFrame(rows, columns=["source", "width", "height"])

    detect = lambda source, row, _: _found_boxes(source, row[0], _grey(row), detector)
    found = files.map_frames(wanted.select("source", "frame").distinct(), videos, detect, _BOX, video, seek_gap, run_frames)
    boxes = bx.suppress(bx.confident(found, params.confidence), params.iou)
    decode = lambda source, row, crops: _found_tags(source, row[0], _grey(row), [tuple(int(v) for v in c) for c in crops], decoder, params)
    tags = lambda layout: files.map_frames(layout.select("source", "frame", *_CROP), videos, decode, _DECODE, video, seek_gap, run_frames)
    return _observed(boxes, settle(videos.mapInPandas(shapes, "source string, width int, height int")), ["source"], tags, params)


def _observed(boxes: DataFrame, size: DataFrame, on: list[str], decode: Callable[[DataFrame], DataFrame], params: ObserveParams) -> tuple[DataFrame, DataFrame, DataFrame]:
    boxes = settle(boxes)
    sized = boxes.join(size.withColumnsRenamed({"width": "_width", "height": "_height"}), on)
    layout = settle(bx.crop_layout(sized, F.col("_width"), F.col("_height"), params.pad_ratio).drop("_width", "_height"))
    found = bx.decodes_to_boxes(decode(layout), layout)
    x, y = F.col("crop_x1") - F.col("strip_x"), F.col("crop_y1")
    placed = found.join(layout.select("source", "frame", "box_id", "crop_x1", "crop_y1", "strip_x"), ["source", "frame", "box_id"])
    placed = settle(placed.withColumns({c: (F.col(c) + (x if c.endswith("x") else y)).cast("float") for c in CORNERS}))
    tags = bx.near_box_center(bx.valid_ids(placed.where("tag_id >= 0"), params.max_tag_id, params.silenced), params.max_offset_ratio)
    marked = bx.all_boxes(boxes, tags)
    detections = tags.select("source", "frame", F.col("decode_idx").alias("det_id"), "tag_id", "center_x", "center_y", *CORNERS)
    quads = bx.lone_quads(placed.where("tag_id = -1"), marked).select("source", "frame", "center_x", "center_y", *CORNERS)
    return detections, marked, quads
