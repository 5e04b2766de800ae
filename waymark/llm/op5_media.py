"""Operator 5, media columns as lossless WebP.

A payload of bytes is stored as an image of 8-bit samples (green channel): repeats
as back-references, few distinct bytes as a palette where that is smaller, and
prefix codes fitted to the rest.  Stored images are decoded to pixel arrays by
``webp.decode``, which reads the whole lossless format: prefix codes and code
groups, back-references, colour cache, and predictor, cross-colour,
subtract-green and palette transforms.  The writer uses neither cache nor the
other transforms: in an image of one channel a cached pixel costs what its
literal does, and differences of letters take more bits than letters.

Defined results: a null or empty text is 64 bytes of 0; equal texts have equal
values; rows are treated one by one, so ties and repeated rows don't matter; an
empty table gives an empty result; other columns are ignored.  ``decode_images``
gives a null size and array for a null or broken file, with the reason.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import webp
from .arrays import pieces
from .common import table
from .worker import tidy

UNIT = 64


def _payload(data: bytes) -> bytes:
    return data + b"\0" * (max(-(-len(data) // UNIT), 1) * UNIT - len(data))


def to_image(payload: bytes) -> bytes:
    """A WebP file of the payload: rows of 64 samples, doubled while there are too many rows; the rest is 0."""
    width = UNIT
    while -(-len(payload) // width) > webp.MAX_SIDE:
        width *= 2
    height = -(-len(payload) // width)
    samples = np.zeros(width * height, np.uint8)
    samples[: len(payload)] = np.frombuffer(payload, np.uint8)
    return webp.encode_samples(samples.reshape(height, width))


def from_image(file: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """Pixels of a file, and the first ``n`` samples of its green channel."""
    pixels = webp.decode(file)
    return pixels, ((pixels >> np.uint32(8)) & np.uint32(0xFF)).astype(np.uint8).ravel()[:n].tobytes()


def feature(pixels: np.ndarray, samples: bytes) -> str:
    """Size, and mean, deviation, distinct values and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    mean = float((share * np.arange(256)).sum())
    deviation = max(float((share * np.arange(256) ** 2).sum()) - mean * mean, 0.0) ** 0.5
    used = share[share > 0]
    entropy = abs(float(-(used * np.log2(used)).sum()))
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean={mean:.3f} sd={deviation:.3f} distinct={len(used)} entropy={entropy:.3f}"


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(text: str | None) -> tuple:
    data = (text or "").encode()
    payload = _payload(data)
    file = to_image(payload)
    pixels, back = from_image(file, len(payload))
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(file), hashlib.sha256(file).hexdigest(), feature(pixels, back)


def digests(docs: DataFrame) -> DataFrame:
    """Store each text, read it back, and describe what was read."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in _OUT.split(", ")]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = [_digest(t.as_py()) for t in part.column("text")]
                columns = zip(*rows, strict=True) if rows else ((),) * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _OUT)


def encode_column(docs: DataFrame, column: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the stored form of a text column in binary column ``media``."""

    @F.pandas_udf("binary")
    def store(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: to_image(_payload((t or "").encode())))

    return docs.withColumn(media, store(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def decode_images(images: DataFrame, key: str, media: str = "media") -> DataFrame:
    """key, width, height, pixels (array of 32-bit numbers as long) and error of each WebP file.

    Files are decoded and returned one by one, so a task holds one image (of at
    most 16,384 pixels a side) and its pixels, whatever the batch.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
        for batch in batches:
            for k, file in enumerate(batch.column("media")):
                try:
                    if not file.is_valid:
                        raise webp.WebPError("no file")
                    pixels = webp.decode(file.as_py())
                    row = (pixels.shape[1], pixels.shape[0], pixels.ravel().astype(np.int64), None)
                except webp.WebPError as e:
                    row = (None, None, None, str(e))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(k, 1), *(pa.array([v], t) for v, t in zip(row, kinds, strict=True))], ["key", "width", "height", "pixels", "error"])

    kind = images.schema[key].dataType.simpleString()
    rows = images.select(F.col(key).alias("key"), F.col(media).alias("media"))
    return rows.mapInArrow(run, f"key {kind}, width int, height int, pixels array<long>, error string").withColumnRenamed("key", key)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
