"""Operator 2, exact repeats of 50 bytes across documents.

A byte is removed if a 50-byte string covering it also starts in a document
with a smaller id.  The method sorts sampled suffixes and compares neighbours:

1. Sample.  In place of fixed residues, the sample is chosen by content: of each
   50-byte window the 20-byte gram with the lowest hash.  Like a difference
   cover it meets any two equal windows at the same offset, so every match is
   seen at a shared sample, with one suffix in sixteen kept instead of two in
   three.
2. Triples.  A sampled suffix is named by the triple (30 bytes before, gram, 30
   bytes after).  Equal grams meet in one task, sorted by triple and document:
   neighbours of the same triple share all windows around the gram.
3. Merge.  Samples whose triples differ, but agree on 15 bytes before or after,
   fetch their 80 bytes; the 31 windows around the gram are sorted by name and
   document, and neighbours compared.
4. The spans found are joined back to the documents.

Hot grams, of which a sample of the texts foretells over ``HOT_ENTRIES``, never
meet by gram: each window whose lowest gram is hot goes to the bucket of its own
hash, after the windows met in one piece of text are settled there.  So a line or
passage that many documents have, each in a context of its own, costs a bucket one
entry a piece for each window that is shared, and spreads those that aren't.

Copies met within a task are settled there, so a text that makes up a third of
all rows costs one entry a task and gram.  Between steps, entries travel as
packed arrays, one row a task and bucket.  The full difference cover over all
suffixes (see README) doesn't fit the disk limits.  Grams, triples and windows
are compared by hashes of 96 (gram and triple) and 104 bits.

Defined results: a null text is empty; texts under 50 bytes keep all; rows of
one id never remove each other's bytes, whatever their texts; a null id counts
as larger than all; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import grams_hash, mix, pieces, powers, rolling, spans_hash, text_bytes
from .common import settle_table, table
from .idfilter import having, id_filter, ids_of, passes, place
from .worker import tidy

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM
HALF = REACH // 2
#: Texts sampled at a time: the arrays alive at once take some 100 bytes a byte of text, and should fit a cache.
SAMPLE_BYTES = 128 << 10
#: Entries of about so many bytes of text are settled and packed together: one row a bucket.
PACK_BYTES = 2 << 20
#: Bytes of text whose samples a bucket may hold: some 30 MB of entries.
BUCKET_BYTES = 16 << 20
#: Grams with more entries than this are hot, as far as a sample of about ``HOT_BYTES`` of text can tell from ``HOT_SEEN`` entries at least.
HOT_ENTRIES, HOT_BYTES, HOT_SEEN = 5000, 64 << 20, 16
_ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
_SAMPLE, _COVER, _ASK, _WINDOW = 0, 1, 2, 3
#: Fields of packed entries: name, bytes kept of a little-endian value, and its type.
_ENTRY = (("gram", 5, np.uint64), ("triple", 7, np.uint64), ("doc", 8, np.int64), ("pos", 4, np.uint32), ("left", 1, np.uint8), ("right", 1, np.uint8), ("near_l", 1, np.uint8), ("near_r", 1, np.uint8))
_COVERED = (("doc", 8, np.int64), ("start", 4, np.uint32), ("end", 4, np.uint32), ("check", 4, np.uint32))
_HOT = (("name", 8, np.uint64), ("hot", 3, np.uint32), ("doc", 8, np.int64), ("start", 4, np.uint32))
_ASKED = (("gram", 5, np.uint64), ("doc", 8, np.int64), ("pos", 4, np.uint32))
_CONTEXT = (("gram", 5, np.uint64), ("doc", 8, np.int64), ("pos", 4, np.uint32), ("left", 1, np.uint8), ("right", 1, np.uint8))


def _pack(fields, columns: dict[str, np.ndarray]) -> bytes:
    """Arrays as byte planes; ids as differences, so that the shuffle's compression finds the zeros."""
    parts = []
    for name, width, kind in fields:
        x = np.ascontiguousarray(columns[name], dtype=kind)
        if name == "doc" and len(x):
            x = np.diff(x, prepend=np.int64(0))
        parts.append(x.view(np.uint8).reshape(len(x), -1)[:, :width].T.tobytes())
    return b"".join(parts)


def _unpack(fields, payloads: list[bytes]) -> dict[str, np.ndarray]:
    width = sum(f[1] for f in fields)
    out: dict[str, list[np.ndarray]] = {f[0]: [] for f in fields}
    for payload in payloads:
        n, at = len(payload) // width, 0
        raw = np.frombuffer(payload, np.uint8)
        for name, w, kind in fields:
            size = np.dtype(kind).itemsize
            x = np.zeros((n, size), np.uint8)
            x[:, :w] = raw[at : at + n * w].reshape(w, n).T
            x = x.reshape(-1).view(kind)
            out[name].append(np.cumsum(x, dtype=np.int64) if name == "doc" else x)
            at += n * w
    return {name: np.concatenate(out[name]) if out[name] else np.zeros(0, kind) for name, _, kind in fields}


def _by_bucket(kind: int, fields, columns: dict[str, np.ndarray], bucket: np.ndarray, extra: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_bucket, prepend=-1))
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=False):
        k = order[a:b]
        payload = _pack(fields, {c: v[k] for c, v in columns.items()})
        if extra is not None:
            payload += extra[k].tobytes()
        rows.append((kind, int(sorted_bucket[a]), payload))
    return rows


def _to_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kind, bucket, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], schema=_ROWS)


def _gram_bucket(gram: np.ndarray, buckets: int) -> np.ndarray:
    return (gram % np.uint64(buckets)).astype(np.int64)


def _cover_rows(doc, start, end, check, buckets: int) -> list[tuple[int, int, bytes]]:
    columns = {"doc": doc, "start": start, "end": end, "check": check}
    return _by_bucket(_COVER, _COVERED, columns, place(doc, buckets))


def _lowest(buf: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all grams, the lowest of each window (0 where it isn't within a row), and the row of each byte."""
    n = len(buf)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    if n < LENGTH:
        none = np.zeros(0, np.uint64)
        return none, none, row
    gram = grams_hash(sums, GRAM)
    low = gram
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: -(REACH - 15)], low[REACH - 15 :])  # of windows of 31 grams
    low[row[LENGTH - 1 :] != row[: n - LENGTH + 1]] = 0
    return gram, low, row


def _sampled(gram: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Positions of the grams that are the lowest of a window."""
    if not len(low):
        return np.zeros(0, np.int64)
    high = np.zeros(len(low) + 2 * REACH, np.uint64)
    high[REACH:-REACH] = low
    for step in (1, 2, 4, 8):
        high = np.maximum(high[:-step], high[step:])
    high = np.maximum(high[: -(REACH - 15)], high[REACH - 15 :])
    return np.flatnonzero((high == gram) & (gram > 0))


def sample(buf: np.ndarray, at: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the sampled grams, their hashes and their rows."""
    gram, low, row = _lowest(buf, at, sums)
    pos = _sampled(gram, low)
    return pos, gram[pos], row[pos].astype(np.int64)


def _context(pos: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(pos - at[row], REACH), np.minimum(at[row + 1] - pos - GRAM, REACH)


def _first_of(*keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry the lowest and the highest doc among the entries with the same keys."""
    order = np.lexsort((doc, *keys))
    if not len(order):
        return doc, doc
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    low, high = np.empty_like(doc), np.empty_like(doc)
    low[order] = doc[order][begin][group]
    high[order] = doc[order][np.append(begin[1:], len(order)) - 1][group]
    return low, high


@tidy
def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", SAMPLE_BYTES):
            buf, at = text_bytes(part.column("text"))
            gram, n = np.unique(sample(buf, at, rolling(buf))[1] >> np.uint64(24), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["gram", "n"])


def hot_grams(texts: DataFrame, size: int) -> np.ndarray:
    """Sorted names of the hot grams of ``size`` bytes of text; some hundred thousand at most, by the sample's size.  Results don't depend on which they are."""
    share = min(1.0, HOT_BYTES / max(size, 1))
    drawn = texts.select("text").sample(share, 7) if share < 1 else texts.select("text")
    counts = drawn.mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(HOT_SEEN, int(HOT_ENTRIES * share))).select("gram").toPandas()["gram"]
    return np.sort(found.to_numpy(np.int64)).astype(np.uint64)


def _among(gram: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each name is in the sorted ``hot``, and its place there."""
    if not len(hot):
        return np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
    k = np.minimum(np.searchsorted(hot, gram), len(hot) - 1)
    return hot[k] == gram, k


def _hot_windows(low, row, at, ids, sums, hot: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Windows whose lowest gram is hot: spans of those that a smaller document of this piece has, and entries of the rest."""
    begin = np.flatnonzero(low)
    inside, place_of = _among(low[begin] >> np.uint64(24), hot)
    begin, place_of = begin[inside], place_of[inside]
    name, of = spans_hash(sums, begin, begin + LENGTH), row[begin]
    doc = ids[of]
    copy = doc > _first_of(name, place_of, doc=doc)[0]
    b, r = begin[copy], of[copy]
    new = np.ones(len(b), bool)
    new[1:] = (np.diff(b) > 1) | (r[1:] != r[:-1])  # windows one byte apart make one span
    first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], [True] * min(len(b), 1)))
    start, end, r = b[first], b[last] + LENGTH, r[first]
    spans = {"doc": ids[r], "start": start - at[r], "end": end - at[r], "check": spans_hash(sums, start, end) & np.uint64(0xFFFFFFFF)}
    k = ~copy
    return spans, {"name": name[k], "hot": place_of[k].astype(np.uint32), "doc": doc[k], "start": (begin[k] - at[of[k]]).astype(np.uint32)}


def _piece_entries(part: pa.RecordBatch, hot: np.ndarray) -> dict[int, dict[str, np.ndarray]]:
    """By kind the entries of one piece of text."""
    buf, at = text_bytes(part.column("text"))
    ids = ids_of(part.column("id"))
    sums = rolling(buf)
    gram, low, row = _lowest(buf, at, sums)
    pos = _sampled(gram, low)
    pos = pos[~_among(gram[pos] >> np.uint64(24), hot)[0]]
    gram = gram[pos]
    found = dict(zip((_COVER, _WINDOW), _hot_windows(low, row, at, ids, sums, hot), strict=True)) if len(hot) else {}
    del low
    row = row[pos].astype(np.int64)
    left, right = _context(pos, row, at)
    whole = spans_hash(sums, pos - left, pos + GRAM + right)
    near = lambda ok, a, b: np.where(ok, spans_hash(sums, np.where(ok, a, 0), np.where(ok, b, HALF)) % np.uint64(255) + np.uint64(1), np.uint64(0)).astype(np.uint8)
    found[_SAMPLE] = {
        "gram": gram, "whole": whole, "doc": ids[row], "pos": (pos - at[row]).astype(np.uint32), "left": left.astype(np.uint8), "right": right.astype(np.uint8),
        "near_l": near(left >= HALF, pos - HALF, pos), "near_r": near(right >= HALF, pos + GRAM, pos + GRAM + HALF),
    }
    return found


def _packed(held: list[dict[int, dict[str, np.ndarray]]], buckets: int) -> pa.RecordBatch:
    """Rows of the entries of several pieces; samples that a smaller document among them shares whole are settled here."""

    def together(kind: int) -> dict[str, np.ndarray]:
        parts = [h[kind] for h in held if kind in h]
        return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]} if parts else {}

    spans, windows, e = together(_COVER), together(_WINDOW), together(_SAMPLE)
    rows = _cover_rows(spans["doc"], spans["start"], spans["end"], spans["check"], buckets) if spans else []
    if windows:
        rows += _by_bucket(_WINDOW, _HOT, windows, _gram_bucket(windows["name"], buckets))
    whole = e.pop("whole")
    e["triple"] = (whole ^ (e["left"].astype(np.uint64) << np.uint64(48))) & np.uint64((1 << 56) - 1)
    copy = e["doc"] > _first_of(e["triple"], e["gram"], doc=e["doc"])[0]
    pos, left, right = (e[c][copy].astype(np.int64) for c in ("pos", "left", "right"))
    rows += _cover_rows(e["doc"][copy], pos - left, pos + GRAM + right, whole[copy] & np.uint64(0xFFFFFFFF), buckets)
    e = {c: v[~copy] for c, v in e.items()}
    bucket = _gram_bucket(e["gram"], buckets)
    e["gram"] = e["gram"] >> np.uint64(24)
    return _to_batch(rows + _by_bucket(_SAMPLE, _ENTRY, e, bucket))


def _sampler(buckets: int, hot: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in pieces(batch, "text", SAMPLE_BYTES):
                held.append(_piece_entries(part, hot))
                size += part.column("text").nbytes
                if size >= PACK_BYTES:
                    yield _packed(held, buckets)
                    held, size = [], 0
        if held:
            yield _packed(held, buckets)

    return run


def _match_triples(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Sort one bucket's samples: covered spans of repeated triples, and requests for the undecided; or match its hot windows."""

    @tidy
    def run(group: pa.Table) -> pa.Table:
        if group.num_rows and group.column("kind")[0].as_py() == _WINDOW:
            w = _unpack(_HOT, group.column("payload").to_pylist())
            copy = w["doc"] > _first_of(w["name"], w["hot"], doc=w["doc"])[0]
            start = w["start"][copy].astype(np.int64)
            return pa.Table.from_batches([_to_batch(_cover_rows(w["doc"][copy], start, start + LENGTH, w["name"][copy] & np.uint64(0xFFFFFFFF), buckets))])
        if not group.num_rows or group.column("kind")[0].as_py() != _SAMPLE:
            return group.select(_ROWS.names)
        e = _unpack(_ENTRY, group.column("payload").to_pylist())
        doc, gram = e["doc"], e["gram"]
        copy = doc > _first_of(e["triple"], gram, doc=doc)[0]
        pick = lambda c: e[c][copy].astype(np.int64)
        rows = _cover_rows(doc[copy], pick("pos") - pick("left"), pick("pos") + GRAM + pick("right"), e["triple"][copy] & np.uint64(0xFFFFFFFF), buckets)
        e = {c: v[~copy] for c, v in e.items()}
        undecided = np.zeros(len(e["doc"]), bool)
        for side in ("near_l", "near_r"):
            low, high = _first_of(e[side], e["gram"], doc=e["doc"])
            undecided |= (low != high) & (e[side] > 0)
        asked = {c: e[c][undecided] for c in ("gram", "doc", "pos")}
        rows += _by_bucket(_ASK, _ASKED, asked, place(asked["doc"], buckets))
        return pa.Table.from_batches([_to_batch(rows)])

    return run


def _fetch(buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The bytes around the asked samples, by bucket of the gram."""

    @tidy
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        want = _unpack(_ASKED, asked.column("payload").to_pylist())
        order = np.argsort(want["doc"], kind="stable")
        sorted_doc, rows = want["doc"][order], []
        for batch in texts.combine_chunks().to_batches():
            for part in pieces(batch, "text"):
                buf, at = text_bytes(part.column("text"))
                ids, sums = ids_of(part.column("id")), rolling(buf)
                a, b = np.searchsorted(sorted_doc, ids), np.searchsorted(sorted_doc, ids, "right")
                row = np.repeat(np.arange(len(ids)), b - a)
                k = order[np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)]).astype(np.int64)] if len(row) else np.zeros(0, np.int64)
                pos = at[row] + want["pos"][k]
                inside = pos + GRAM <= at[row + 1]
                k, row, pos = k[inside], row[inside], pos[inside]
                same = spans_hash(sums, pos, pos + GRAM) >> np.uint64(24) == want["gram"][k]  # another text of this id has its own
                k, row, pos = k[same], row[same], pos[same]
                left, right = _context(pos, row, at)
                padded = np.concatenate([np.zeros(REACH, np.uint8), buf, np.zeros(REACH + GRAM, np.uint8)])
                around = padded[pos[:, None] + np.arange(REACH + GRAM + REACH)]
                columns = {"gram": want["gram"][k], "doc": ids[row], "pos": want["pos"][k], "left": left, "right": right}
                rows += _by_bucket(_ASK, _CONTEXT, columns, _gram_bucket(columns["gram"], buckets), around)
        return pa.Table.from_batches([_to_batch(rows)])

    return run


def _match_windows(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """Sort the windows around one bucket's undecided samples; spans of those that a smaller document has."""
    span, fixed = REACH + GRAM + REACH, sum(f[1] for f in _CONTEXT)

    @tidy
    def run(group: pa.Table) -> pa.Table:
        heads, around = [], []
        for payload in group.column("payload").to_pylist():
            n = len(payload) // (fixed + span)
            heads.append(payload[: n * fixed])
            around.append(np.frombuffer(payload, np.uint8, offset=n * fixed).reshape(n, span))
        c, around = _unpack(_CONTEXT, heads), np.concatenate(around)
        p, inverse = powers(span + 1)
        sums = np.zeros((len(around), span + 1), np.uint64)
        np.cumsum((around.astype(np.uint64) + np.uint64(1)) * p[:span], axis=1, out=sums[:, 1:])
        doc, first, last = c["doc"], np.full(len(around), REACH + 1), np.full(len(around), -1)
        for before in range(REACH + 1):
            k = np.flatnonzero((c["left"] >= before) & (c["right"] >= REACH - before))
            a = REACH - before
            name = (sums[k, a + LENGTH] - sums[k, a]) * inverse[a]
            found = k[doc[k] > _first_of(name, c["gram"][k], doc=doc[k])[0]]
            first[found] = np.minimum(first[found], before)
            last[found] = before
        k = np.flatnonzero(last >= 0)
        start, end = c["pos"][k].astype(np.int64) - last[k], c["pos"][k].astype(np.int64) - first[k] + LENGTH
        a, b = REACH - last[k], REACH - first[k] + LENGTH
        check = mix((sums[k, b] - sums[k, a]) * inverse[a] + (b - a).astype(np.uint64))
        return pa.Table.from_batches([_to_batch(_cover_rows(doc[k], start, end, check & np.uint64(0xFFFFFFFF), buckets))])

    return run


def _packed_ids(fields) -> Callable[[pa.RecordBatch], np.ndarray]:
    return lambda batch: _unpack(fields, batch.column("payload").to_pylist())["doc"]


def _having(bits: np.ndarray, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows whose id may be in the filter, with their bucket."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept in having(bits)(batches):
            bucket = place(ids_of(kept.column("id")), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *kept.columns], ["bucket", *kept.schema.names])

    return run


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
_OUT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _result(part: pa.RecordBatch, buf: np.ndarray, at: np.ndarray, gone: np.ndarray, with_text: bool) -> pa.RecordBatch:
    rows = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        cut = gone[a:b]
        kept = buf[a:b][~cut].tobytes()
        spans = int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1))
        rows.append((b - a, int(np.count_nonzero(cut)), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
    columns = zip(*rows, strict=True) if rows else ((),) * 5
    arrays = [part.column("id").cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(_FIELDS)[1:], strict=True))]
    row = [part.column("row")] if "row" in part.schema.names else []
    return pa.RecordBatch.from_arrays(arrays + row, [*_FIELDS.names, *["row"] * len(row)])


def _untouched(bits: np.ndarray, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.filter(pa.array(~passes(bits, ids_of(batch.column("id")))))
            for part in pieces(rest, "text"):
                buf, at = text_bytes(part.column("text"))
                yield _result(part, buf, at, np.zeros(len(buf), bool), with_text)

    return run


def _cut(with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    @tidy
    def run(texts: pa.Table, covered: pa.Table) -> pa.Table:
        c = _unpack(_COVERED, covered.column("payload").to_pylist())
        order = np.argsort(c["doc"], kind="stable")
        sorted_doc, out = c["doc"][order], []
        for batch in texts.combine_chunks().to_batches():
            for part in pieces(batch, "text"):
                buf, at = text_bytes(part.column("text"))
                ids, sums = ids_of(part.column("id")), rolling(buf)
                a, b = np.searchsorted(sorted_doc, ids), np.searchsorted(sorted_doc, ids, "right")
                row = np.repeat(np.arange(len(ids)), b - a)
                k = order[np.concatenate([np.arange(x, y) for x, y in zip(a, b, strict=True)]).astype(np.int64)] if len(row) else np.zeros(0, np.int64)
                start, end = at[row] + c["start"][k], at[row] + c["end"][k]
                inside = end <= at[row + 1]
                start, end, check = start[inside], end[inside], c["check"][k][inside]
                same = (spans_hash(sums, start, end) & np.uint64(0xFFFFFFFF)) == check  # spans of another text of this id
                depth = np.bincount(start[same], minlength=len(buf) + 1) - np.bincount(end[same], minlength=len(buf) + 1)
                out.append(_result(part, buf, at, np.cumsum(depth)[: len(buf)] > 0, with_text))
        if not out:
            out.append(_result(texts.slice(0, 0).combine_chunks().to_batches()[0] if texts.to_batches() else pa.RecordBatch.from_pylist([], texts.schema), *text_bytes(pa.array([], pa.string())), np.zeros(0, bool), with_text))
        return pa.Table.from_batches(out)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text of every row.

    ``kept_text`` leaves out a character of which a byte was removed.  With
    ``carry``, column ``row`` has all columns of the row but ``text``.
    """
    spark = docs.sparkSession
    rows_sql = "kind int, bucket int, payload binary"
    row = [F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), *row)
    texts = rows.select("id", "text")
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    row_type = f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    sampled = texts.mapInArrow(_sampler(buckets, hot_grams(texts, size)), rows_sql)
    matched = settle_table(sampled.groupBy("kind", "bucket").applyInArrow(_match_triples(buckets), rows_sql))
    asked = matched.where(F.col("kind") == _ASK)
    wanted = texts.mapInArrow(_having(id_filter(asked, _packed_ids(_ASKED)), buckets), "bucket int, id long, text string")
    contexts = wanted.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_fetch(buckets), rows_sql)
    partial = settle_table(contexts.groupBy("bucket").applyInArrow(_match_windows(buckets), rows_sql))
    covered = matched.where(F.col("kind") == _COVER).unionByName(partial)
    bits = id_filter(covered, _packed_ids(_COVERED))
    touched = rows.mapInArrow(_having(bits, buckets), "bucket int, id long, text string" + row_type)
    cut = touched.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(_cut(with_text), _OUT_SQL + row_type)
    return cut.unionByName(rows.mapInArrow(_untouched(bits, with_text), _OUT_SQL + row_type))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
