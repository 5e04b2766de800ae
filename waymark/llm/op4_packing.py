"""Operator 4, best-fit packing by length patterns.

Documents become token pieces of at most ``LIMIT`` tokens.  Their lengths form a
histogram of at most ``LIMIT`` rows, which alone goes to the driver.  All ways to
fill a sequence exactly with one, two or three pieces are enumerated; how often
to use each is fitted to the histogram by non-negative least squares, rounded
down, and what remains is packed best fit first.  The plan is a list of patterns
with repeats, bounded by the number of patterns whatever the input, and pieces
find their place in it by their rank among pieces of their length.

Ids are those of the ``tokenizers`` file.  Its merges are applied by tiktoken's
routine to distinct words, which are kept in a bounded memo: the tokenizers
library takes 1,040 CPU seconds a GB of text here, over the limit of the check
tool on its own.  Tests hold the ids against the tokenizers library.  Texts with
a special token's string go through the tokenizers library itself.

Defined results: a null or empty text is one piece holding only the end id;
pieces of one length are dealt by (doc_id, piece), so ties and repeated rows
have their own places; null ids are dealt first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle_table, table
from .memo import Memo
from .worker import tidy

TOKENIZER = "byte_bpe_50k.json"
LIMIT, END_ID = 1024, 2
SALTS = 64
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Ids:
    """Token ids of texts, as little-endian 32-bit bytes, by one tokenizers file (byte-level BPE)."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self._library = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        to_byte = _byte_letters()
        plain = set(self.special)
        ranks = {bytes(to_byte[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in plain}
        self.encoding = tiktoken.Encoding("of_file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = {m: np.array(self.encoding.encode_ordinary(m), np.uint32).tobytes() for m in ".,"}
        self.encode = self.encoding.encode_ordinary
        self.memo = Memo(self._work, limit=200_000)

    @property
    def library(self):
        """The tokenizers library with this file, loaded when a text needs it."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _work(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and word[:-1].isalpha():  # the file's pattern parts letters from marks
            return self.memo[word[:-1]] + self.marks[word[-1]]
        return array("I", self.encode(" " + word)).tobytes()

    def of(self, text: str) -> bytes:
        """A word with the space before it is encoded apart from its neighbours, unless spaces adjoin."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if "  " in text:
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.memo.__getitem__, rest))


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, then from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_ids: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


def _pieces(path: str, limit: int):
    end = np.array([END_ID], np.uint32).tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ids_of(path)
        for batch in batches:
            rows = []
            for doc, scalar in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encoder.of(scalar.as_py() or "") + end
                n, start, piece = len(ids) // 4, 0, 0
                cut = n % limit or limit
                while start < n:
                    rows.append((doc, piece, start, cut - start, zlib.crc32(ids[4 * start : 4 * cut])))
                    start, cut, piece = cut, cut + limit, piece + 1
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length and ids_crc32."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), limit), _PIECES)


def patterns(limit: int) -> np.ndarray:
    """All sorted triples of lengths (0: none) that add up to ``limit``."""
    a, b = np.meshgrid(np.arange(limit + 1), np.arange(limit + 1), indexing="ij")
    c = limit - a - b
    ok = (a <= b) & (b <= c)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit_repeats(histogram: np.ndarray, shapes: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats x of the patterns for which their lengths come closest to the histogram.

    Accelerated projected gradient on |A x - h|^2, where A counts the lengths in
    each pattern; errors are weighted by length, as long pieces are harder to place.
    """
    size = len(histogram)
    weight = np.arange(size) / size
    weight[0] = 0
    usable = ((shapes == 0) | (histogram[shapes] > 0)).all(1)
    x = np.zeros(len(shapes))
    if not usable.any():
        return x
    own = shapes[usable]
    total = lambda v: np.bincount(own.ravel(), np.repeat(v, 3), size)
    gradient = lambda r: (weight * r)[own].sum(1)
    v = np.ones(len(own))
    for _ in range(30):  # the largest curvature, by power iteration
        v = gradient(total(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * np.linalg.norm(gradient(total(v))) + 1e-12)
    h = histogram.astype(float)
    y, best, t = np.zeros(len(own)), np.zeros(len(own)), 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * gradient(total(y) - h), 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y, best = new + (before - 1) / t * (new - best), new
    x[usable] = best
    return x


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and their repeats that use up the histogram (index: length)."""
    limit = len(histogram) - 1
    left, out = histogram.astype(np.int64).copy(), []
    if left[limit]:
        out.append(((limit,), int(left[limit])))
        left[limit] = 0
    shapes = patterns(limit)
    shapes = shapes[shapes[:, 2] < limit]
    repeats = np.floor(fit_repeats(left, shapes)).astype(np.int64)
    for k in np.argsort(-repeats, kind="stable"):
        if repeats[k] <= 0:
            break
        lengths, count = np.unique(shapes[k][shapes[k] > 0], return_counts=True)
        n = int(min(repeats[k], (left[lengths] // count).min()))
        if n:
            left[lengths] -= n * count
            out.append((tuple(int(x) for x in shapes[k] if x), n))
    while left.any():  # the rest: longest piece first, then the longest that still fits
        remaining, held = left.copy(), []
        room = limit
        while True:
            fits = np.flatnonzero(remaining[: room + 1])
            if not len(fits):
                break
            held.append(int(fits[-1]))
            remaining[fits[-1]] -= 1
            room -= int(fits[-1])
        lengths, count = np.unique(held, return_counts=True)
        n = int((left[lengths] // count).min())
        left[lengths] -= n * count
        out.append((tuple(held), n))
    return out


def _places(of: list[tuple[tuple[int, ...], int]]):
    """For each length and run of ranks: first rank, first sequence and offset, sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for shape, n in of:
        offset = 0
        for length in shape:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    places = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return (places[:, 0] << 44) + places[:, 1], places


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    counts = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``limit`` rows
    histogram = np.zeros(limit + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["n"]
    keys, places = _places(plan(histogram))

    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int"))
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # at most limit * SALTS rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = per.select("length", "salt", F.coalesce(before, F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(F.broadcast(starts), ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(order) - 1)

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            sequence, offset = places[k, 2] + rank - places[k, 1], places[k, 3]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, _PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    return pack(settle_table(token_pieces(docs, tokenizer, limit)), limit)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
