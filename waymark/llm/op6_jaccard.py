"""Operator 6, n-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

A document is the set of its distinct word shingles.  Two documents link when
``100 * |A and B| >= percent * |A or B|``.

1. Documents of one set form a class; its lowest id stands for it.
2. Tiles: a class is put on the tile of each shingle in its prefix: those with
   the lowest hashes, but common shingles come last of all.  Linked sets share
   one there, so no link is lost; the shingle's place bounds the size of a
   partner.  Tiles of one class go.
3. Stars: on each tile every class is paired with the lowest id, as copies
   mostly follow their original.  Verified stars join groups of near copies in
   linear work.
4. Tiles again, sorted by size: classes not yet in one component are compared
   if their sizes allow a link.  Hashed bitmaps (a power of two of bits, twice
   the set size or more) bound the overlap from above by their bit counts: first
   bitmaps folded to ``SHORT`` bytes, which travel with the tiles, then for the
   distinct pairs of larger sets the whole ones.
5. Pairs within the bound are verified on whole texts by intersecting sorted
   shingle arrays.  Verified links give the components.

Which shingles are common is told by a sample of about ``SAMPLE_BYTES`` of text;
the order of a prefix, and the way its tiles are built, depend on it, results
don't.  As common shingles come last, a document is on the tile of a line or
passage that many have only if it consists of such parts for the most.  Tiles of
common shingles are summed up by partial aggregates and joined back to their
rows, so that no window holds them; the others meet in windows.  A tile of more
than ``TILE`` classes that stars have not made one component is cut into size
bands and blocks, each pair of blocks being a tile of its own, so no task holds a
large group.

Shingles are compared by 64-bit hashes.  Defined results: a null, empty or
blank text has an empty set and links with nothing; fewer words than a shingle
form one shingle; rows sharing an id count as linked; a row without an id is
its own null component unless its set occurs elsewhere; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import pieces, shingle_sets
from .common import drop_table, join_lookup, join_spread, settle, settle_table, table
from .components import components
from .idfilter import having, id_filter
from .worker import tidy

WIDTH, PERCENT = 4, 85
TILE = 4096
_BLOCK_BYTES = 8 << 20
#: Bytes of the bitmaps that travel with tiles.
SHORT = 128
#: Shingles of over ``COMMON_ROWS`` documents are common, as far as a sample of about ``SAMPLE_BYTES`` of text can tell from ``COMMON_SEEN`` documents at least.
COMMON_ROWS, SAMPLE_BYTES, COMMON_SEEN = 1000, 32 << 20, 16
_FEATURES = "id long, n long, digest binary, long_prefix array<long>, n_common int, bits binary"


def _need(a, b, percent: int):
    """The least overlap of sets of sizes a and b that link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _bitmap(hashes: np.ndarray) -> bytes:
    n = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[(hashes & np.uint64(n - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _counts(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                token, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(part.column("text"), width)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], ["token", "n"])

    return run


def common_shingles(texts: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of the common shingles; at most some 300,000, by the sample's size."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    draw = F.pmod(F.xxhash64(F.lit("shingle sample"), "id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = texts.where(draw < share).mapInArrow(_counts(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(COMMON_SEEN, int(COMMON_ROWS * share))).select("token").toPandas()["token"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def _prefix(hashes: np.ndarray, size: int, common: np.ndarray) -> tuple[np.ndarray, int]:
    """The first ``size`` of a sorted set, common ones last, and how many of them are common."""
    known = np.isin(hashes, common, assume_unique=True) if len(common) else np.zeros(len(hashes), bool)
    rare = hashes[~known][:size]
    often = hashes[known][: size - len(rare)]
    return np.concatenate([rare, often]), len(often)


def _features(width: int, percent: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("long_prefix", pa.list_(pa.int64())), ("n_common", pa.int32()), ("bits", pa.binary())])
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                size = [len(s) for s in sets]
                reach = [n - -(-percent * n // 100) + 1 if n else 0 for n in size]
                prefix = [_prefix(s, k, common) for s, k in zip(sets, reach, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(size, pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([p.view(np.int64) for p, _ in prefix], pa.list_(pa.int64())),
                        pa.array([c for _, c in prefix], pa.int32()),
                        pa.array([_bitmap(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def _bound(bits: np.ndarray, at: np.ndarray, n_words: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows may link, by bit counts; the wider bitmap is folded onto the narrower."""
    keep = np.zeros(len(i), bool)
    least = np.minimum(n_words[i], n_words[j])
    for w in np.unique(least):
        for k in np.array_split(np.flatnonzero(least == w), max(1, int((least == w).sum() * w) >> 20)):

            def folded(rows: np.ndarray, w: int = int(w)) -> np.ndarray:
                out = bits[at[rows][:, None] + np.arange(w)]
                for more in range(1, int((n_words[rows] // w).max(initial=1))):
                    wide = n_words[rows] > more * w
                    out[wide] |= bits[at[rows[wide]][:, None] + more * w + np.arange(w)]
                return out

            x, y = folded(i[k]), folded(j[k])
            a, b = size[i[k]], size[j[k]]
            only_x = np.bitwise_count(x & ~y).sum(1, dtype=np.int64)
            only_y = np.bitwise_count(y & ~x).sum(1, dtype=np.int64)
            keep[k] = np.minimum(a - only_x, b - only_y) >= _need(a, b, percent)
    return keep


def _shortened(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with bitmaps folded to at most ``limit`` bytes."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [b if len(b) <= limit else np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, limit)).tobytes() for b in batch.column("bits").to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("bits"), "bits", pa.array(bits, pa.binary()))

    return run


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps as one array of 64-bit words, where each begins, and its words."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bits = np.frombuffer(np.frombuffer(data, np.uint8)[at[0] : at[-1]].tobytes(), np.uint64)
    return bits, (at[:-1] - at[0]) // 8, np.diff(at) // 8


_TILE_KEYS = ["token", "band", "bi", "bj"]


def _tile_pairs(percent: int, short: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Candidate pairs of rows sorted by tile and size; tiles may span batches."""

    def of(t: pa.Table) -> pa.RecordBatch:
        col = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        tile = [col(c) for c in _TILE_KEYS]
        ids, comp, size, cap, band, block, one, two = (col(c) for c in ("id", "comp", "n", "cap", "own_band", "block", "before1", "before2"))
        bits, at, n_words = _words_of(t.column("bits").combine_chunks())
        same = np.ones(max(t.num_rows - 1, 0), bool)
        for c in tile:
            same &= c[1:] == c[:-1]
        group = np.concatenate([[0], np.cumsum(~same)]) if t.num_rows else np.zeros(0, np.int64)
        lead, found = np.arange(t.num_rows), []
        for step in range(1, t.num_rows):
            lead = lead[lead + step < t.num_rows]
            after = lead + step
            near = (group[lead] == group[after]) & (100 * size[lead] >= percent * size[after])
            lead, after = lead[near], after[near]  # sizes ascend: what is too large stays so
            if not len(lead):
                break
            new = (comp[lead] != comp[after]) & (size[after] <= cap[lead]) & (size[lead] <= cap[after])
            for x in (one, two):  # a shared shingle just before this one: that tile has the pair
                new &= (x[lead] != one[after]) & (x[lead] != two[after])
            cut = tile[1][lead] >= 0  # a tile of bands and blocks: its own pairs only
            new &= ~cut | ((np.minimum(band[lead], band[after]) == tile[1][lead]) & ((block[lead] != block[after]) | (tile[2][lead] == tile[3][lead])))
            i, j = lead[new], after[new]
            if len(i):
                ok = _bound(bits, at, n_words, size, i, j, percent)
                found.append(np.stack([ids[i[ok]], ids[j[ok]]]))
        pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        wide = size > 4 * short  # over 8 * short bits
        pairs = np.unique(np.sort(pairs, 0), axis=1)
        large = np.isin(pairs[0], ids[wide]) & np.isin(pairs[1], ids[wide])
        return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64()), pa.array(large)], ["a", "b", "large"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > _BLOCK_BYTES:
                t = pa.Table.from_batches(held)
                other = np.zeros(t.num_rows, bool)
                for c in _TILE_KEYS:
                    x = t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
                    other |= x != x[-1]
                begun = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
                if begun:
                    yield of(t.slice(0, begun))
                    held = t.slice(begun).combine_chunks().to_batches()
        if held:
            yield of(pa.Table.from_batches(held))

    return run


def _exact(width: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text_a"):
                x, y = (shingle_sets(part.column(c), width) for c in ("text_a", "text_b"))
                size = lambda s: np.array([len(v) for v in s], np.int64)
                both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
                link = 100 * both >= percent * (size(x) + size(y) - both)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(link & (both > 0)))

    return run


def _within_bound(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            if k:
                n = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
                bits, at, n_words = _words_of(pa.concat_arrays([batch.column("bits_a"), batch.column("bits_b")]))
                ok = _bound(bits, at, n_words, n, np.arange(k), np.arange(k, 2 * k), percent)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of whole texts; ``pairs`` is read several times."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bits = id_filter(both, lambda batch: batch.column("id").to_numpy())
    texts = texts.mapInArrow(having(bits), "id long, text string")  # texts of no pair needn't travel
    side = lambda s: texts.select(F.col("id").alias(s), F.col("text").alias(f"text_{s}"))
    pairs = join_spread(pairs, side("a"), "a", "b").join(side("b"), "b")
    return pairs.mapInArrow(_exact(width, percent), "a long, b long").distinct()


def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that whole bitmaps let pass; ``a`` may be the pivot of many."""
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
    return join_spread(pairs.join(side("b"), "b"), side("a"), "a", "b").mapInArrow(_within_bound(percent), "a long, b long").distinct()


def _on_tiles(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """``rows`` (token, common, id, ...) with sums over their tile: by window, or for common shingles by partial aggregates.

    The common ones are one row a shingle, of which the sample bounds the number.
    """
    w = Window.partitionBy("token")
    rare = rows.where(~F.col("common")).withColumns({name: c.over(w) for name, c in sums.items()})
    often = rows.where("common")
    per = settle(often.groupBy("token").agg(*[c.alias(name) for name, c in sums.items()]))
    return rare.unionByName(join_lookup(often, per, ["token"], per.count(), F.col("id")))


def link_table(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features of all rows (id, n, digest), classes (digest, rep) and all verified links (a, b) found.

    The links join every pair of linked classes by a path; within groups that
    the stars joined, further links aren't listed.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(common_shingles(texts, width))
    wide = settle_table(texts.mapInArrow(_features(width, percent, shared), _FEATURES))
    classes = settle(wide.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep")))
    reps = wide.join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi").dropDuplicates(["digest", "id"])
    reps = settle_table(reps.select("id", "n", "long_prefix", "n_common", "bits"))
    features = settle(wide.select("id", "n", "digest"))
    drop_table(wide)

    steps = F.sequence(F.lit(0), F.size("long_prefix") - 1)
    common_from = F.size("long_prefix") - F.col("n_common")
    placed = F.transform(steps, lambda i: F.struct(i.alias("at"), F.get("long_prefix", i).alias("token"), (i >= common_from).alias("common")))
    prefix = reps.select("id", "n", F.inline(placed))
    # after this shingle n - at are left, so a linked partner has at most ``cap``
    cap = F.floor((F.col("n") - F.col("at")) * (100 + percent) / F.lit(percent)) - F.col("n")
    on_tile = prefix.select("token", "common", "id", "n", cap.cast("long").alias("cap"))
    on_tile = _on_tiles(on_tile, {"g": F.count("*"), "useful": F.max(F.col("cap") >= F.col("n")), "pivot": F.min(F.struct("id", "n", "cap"))}).where("g > 1 and useful")
    tiles = settle_table(on_tile.select("token", "common", "id", "n", "cap", "g", F.col("pivot.id").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.cap").alias("pivot_cap")))

    sizes_fit = (100 * F.least("n", "pivot_n") >= percent * F.greatest("n", "pivot_n")) & (F.col("pivot_n") <= F.col("cap")) & (F.col("n") <= F.col("pivot_cap"))
    stars = settle(tiles.where(sizes_fit & (F.col("id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    stars = settle(_bounded(stars, reps, percent))
    star_links = settle(_verified(stars, texts, width, percent))
    joined = settle(components(star_links))

    rows = tiles.join(joined.withColumnRenamed("node", "id"), "id", "left").select("token", "common", "id", "n", "cap", "g", F.coalesce("component", "id").alias("comp"))
    mixed = _on_tiles(rows, {"lo": F.min("comp"), "hi": F.max("comp")}).where("lo <> hi").drop("lo", "hi")
    by_size = Window.partitionBy("token").orderBy("n", "id")
    best = F.max("cap").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    smaller = F.coalesce((100 * F.lag("n").over(by_size) >= percent * F.col("n")) & (best >= F.col("n")), F.lit(False))
    larger = F.coalesce((100 * F.col("n") >= percent * F.lead("n").over(by_size)) & (F.lead("n").over(by_size) <= F.col("cap")), F.lit(False))
    mixed_all = settle_table(mixed)
    fitting = mixed_all.where(~F.col("common")).withColumn("fits", smaller | larger).where("fits").drop("fits")  # else no size on the tile allows a link
    mixed = fitting.unionByName(mixed_all.where("common"))
    short = reps.select("id", "n", "long_prefix", "bits").mapInArrow(_shortened(SHORT), "id long, n long, long_prefix array<long>, bits binary")
    rows = _cut_tiles(mixed.select("token", "id", "n", "cap", "g", "comp"), percent).join(short, ["id", "n"])
    at = F.array_position("long_prefix", F.col("token")).cast("int") - 1
    before = {f"before{k}": F.coalesce(F.when(at >= k, F.get("long_prefix", at - k)), F.xxhash64("id", F.lit(k))) for k in (1, 2)}
    rows = rows.withColumns(before).drop("long_prefix").repartition(*_TILE_KEYS).sortWithinPartitions(*_TILE_KEYS, "n", "id")
    pairs = rows.mapInArrow(_tile_pairs(percent, SHORT), "a long, b long, large boolean").groupBy("a", "b").agg(F.min("large").alias("large"))
    tried = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = settle(pairs.join(tried, ["a", "b"], "left_anti"))
    pairs = settle(pairs.where("NOT large").select("a", "b").unionByName(_bounded(pairs.where("large").select("a", "b"), reps, percent)))
    more_links = _verified(pairs, texts, width, percent)
    links = settle(star_links.unionByName(more_links))
    for used in (tiles, mixed_all, reps):
        drop_table(used)
    return features, classes, links


def _cut_tiles(rows: DataFrame, percent: int) -> DataFrame:
    """Tile keys: the token alone, or with size band and blocks where its group is large."""
    blocks = F.ceil(F.col("g") / TILE).cast("int")
    step = math.log(100 / percent) * (1 + 1e-9)  # sizes that may link are at most one band apart
    band = (F.floor(F.log(F.col("n").cast("double")) / step) + 1).cast("int")
    large = F.col("g") > TILE

    def split(c: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(c, k).alias("bi"), F.greatest(c, k).alias("bj")))
        return F.flatten(F.transform(F.array(F.lit(0), F.lit(1)), lambda d: F.transform(pairs, lambda p: F.struct((F.col("own_band") - d).alias("band"), p["bi"].alias("bi"), p["bj"].alias("bj")))))

    rows = rows.withColumn("own_band", band).withColumn("block", F.when(large, F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int")).otherwise(0))
    whole = F.array(F.struct(F.lit(-1).alias("band"), F.lit(0).alias("bi"), F.lit(0).alias("bj")))
    keyed = rows.withColumn("t", F.explode(F.when(large, split(F.col("block"))).otherwise(whole)))
    return keyed.select("token", F.col("t.band").alias("band"), F.col("t.bi").alias("bi"), F.col("t.bj").alias("bj"), "id", "n", "cap", "comp", "own_band", "block")


def near_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    features, classes, links = link_table(docs, width, percent)
    found = components(links).withColumnRenamed("node", "rep")
    named = classes.join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    with_set = join_spread(features.where("digest IS NOT NULL"), named, "digest", "id")
    lone = features.where("digest IS NULL").withColumn("component_id", F.lit(None).cast("long"))
    # a set that only rows without an id have is in no class
    unnamed = features.where("digest IS NOT NULL AND id IS NULL").join(classes, "digest", "left_anti").withColumn("component_id", F.lit(None).cast("long"))
    out = with_set.unionByName(lone).unionByName(unnamed)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
