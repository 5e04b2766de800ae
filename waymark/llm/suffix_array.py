"""Suffix array by the difference cover {1, 2} modulo 3, in DataFrame steps.

The method operator 2 is named after, whole: sampled triples are sorted and
named, the names are sorted by recursion, the other suffixes are merged in, and
prefixes of neighbours in suffix order are compared.  It gives the spans of
``op2_repeats`` (tests hold the two against each other), but at one row a byte
and some ten shuffles a level it is for tables of megabytes; see the README.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, settle_table

#: A sequence this short is sorted in one task.
BASE = 1 << 12
_COVER = 3


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in global order of the keys, equal keys in one partition, with its number ``part``."""
    by = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return settle_table(by.withColumn("part", F.spark_partition_id()))


def _in_order(df: DataFrame, keys: list[str], kernel, schema: str, flag: Column) -> DataFrame:
    """Run ``kernel(batch, rows before, flagged rows before)`` over the rows of ``_sorted``, in order.

    Of each partition only its two counts go to the driver.
    """
    df = df.withColumn("flag", flag)
    counts = sorted((r["part"], r["n"], r["f"]) for r in df.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("f")).collect())
    before, n, f = {}, 0, 0
    for part, k, flagged in counts:
        before[part] = n, f
        n, f = n + k, f + flagged

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys])
        return kernel(table, *before[table.column("part")[0].as_py()])

    return df.groupBy("part").applyInArrow(run, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _ahead(seq: DataFrame, value: str, k: int, names: list[str]) -> DataFrame:
    """Per position the values at it and the ``k - 1`` places after; 0 beyond the end."""
    moved = seq.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda d: F.struct((F.col("pos") - d).alias("pos"), d.alias("d"), F.col(value).alias("v")))).alias("m")).select("m.*")
    at = [F.coalesce(F.max(F.when(F.col("d") == j, F.col("v"))), F.lit(0).cast("long")).alias(n) for j, n in enumerate(names)]
    return moved.where("pos >= 0").groupBy("pos").agg(*at)


def _small(seq: DataFrame) -> DataFrame:
    """Ranks of a sequence of at most ``BASE`` names, by prefix doubling in one task."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(_column(table, "pos"))
        rank = np.unique(_column(table, "name")[order], return_inverse=True)[1].astype(np.int64) + 1
        step = 1
        while step < len(rank):
            key = rank * (len(rank) + 2) + np.concatenate([rank[step:], np.zeros(step, np.int64)])
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
            step *= 2
        return pa.table({"pos": np.arange(len(rank)), "rank": rank - 1})

    return seq.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "pos long, rank long")


def suffix_ranks(seq: DataFrame, n: int) -> DataFrame:
    """(pos, rank) of the suffixes of ``seq``: (pos, name), positions 0 .. n - 1, names over 0."""
    if n <= BASE:
        return _small(seq)
    n1 = (n + 2) // 3  # places 1 modulo 3, with one beyond the end if n is 1 modulo 3
    triples = settle_table(_ahead(seq, "name", _COVER, ["c0", "c1", "c2"]))
    sampled = triples.where("pos % 3 <> 0")
    dummy = n % 3 == 1
    if dummy:
        sampled = sampled.unionByName(triples.limit(1).select(F.lit(n).cast("long").alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("c0", "c1", "c2")]))

    def name(t: pa.Table, before: int, _: int) -> pa.Table:
        c = [_column(t, k) for k in ("c0", "c1", "c2")]
        new = np.ones(t.num_rows, bool)
        new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(t.num_rows), 0))
        return pa.table({"pos": _column(t, "pos"), "name": before + first + 1, "new": new})

    named = settle_table(_in_order(_sorted(sampled, "c0", "c1", "c2"), ["c0", "c1", "c2", "pos"], name, "pos long, name long, new boolean", F.lit(False)))
    if named.where("NOT new").isEmpty():
        ranks = named.select("pos", F.col("name").alias("rank"))
    else:
        place = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(n1 + F.floor(F.col("pos") / 3))
        deeper = suffix_ranks(settle(named.select(place.alias("pos"), "name")), n1 + n // 3)
        back = F.when(F.col("pos") < n1, 3 * F.col("pos") + 1).otherwise(3 * (F.col("pos") - n1) + 2)
        ranks = deeper.select(back.alias("pos"), (F.col("rank") + 1).alias("rank"))
    own = _ahead(ranks, "rank", _COVER, ["r0", "r1", "r2"])
    rows = settle_table(triples.join(own, "pos", "left").fillna(0, ["r0", "r1", "r2"]).withColumn("rest", F.col("pos") % 3))

    def count(t: pa.Table, before: int, zeros: int) -> pa.Table:
        zero = _column(t, "flag")
        z = zeros + np.cumsum(zero) - zero
        return pa.table({"pos": _column(t, "pos"), "zeros": z, "others": before + np.arange(t.num_rows) - z})

    def merged(other: int, *keys: str) -> DataFrame:
        """How many suffixes of class 0, and of class ``other``, come before each of both."""
        both = _sorted(rows.where(F.col("rest").isin(0, other)).select("pos", "rest", *keys), *keys)
        return _in_order(both, list(keys), count, "pos long, zeros long, others long", F.col("rest") == 0)

    one, two = merged(1, "c0", "r1"), merged(2, "c0", "c1", "r2")
    before = one.select("pos", "zeros", "others", F.lit(1).alias("by")).unionByName(two.select("pos", "zeros", "others", F.lit(2).alias("by")))
    totals = before.groupBy("pos").agg(F.max("zeros").alias("zeros"), F.sum("others").alias("others"))
    final = F.when(F.col("rest") == 0, F.col("zeros") + F.col("others")).otherwise(F.col("zeros") + F.col("r0") - 1 - int(dummy))
    return settle(rows.join(totals, "pos").select("pos", final.alias("rank")))


def _spread(length: int):
    """One row a byte: place in the whole, name, document, and the window that begins there, if it lies within."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, begin, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "begin", "text")), strict=True):
                b = (text or "").encode()
                n = len(b) + 1
                windows = [b[i : i + length] if i + length <= len(b) else None for i in range(n)]
                names = np.append(np.frombuffer(b, np.uint8).astype(np.int64) + 2, 1)
                yield pa.RecordBatch.from_arrays([pa.array(begin + np.arange(n)), pa.array(names), pa.array(np.full(n, doc)), pa.array(windows, pa.binary())], ["pos", "name", "doc", "window"])

    return run


def repeated_starts(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, start) of every window of ``length`` bytes that also starts in a document with a smaller id.

    Ids must be distinct and not null.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))

    def lay(t: pa.Table, before: int, _: int) -> pa.Table:
        size = _column(t, "size")
        return pa.table({"doc": _column(t, "doc"), "begin": before_bytes[t.column("part")[0].as_py()] + np.cumsum(size) - size, "text": t.column("text")})

    laid = _sorted(given.withColumn("size", (F.octet_length("text") + 1).cast("long")), "doc")
    sums = sorted((r["part"], r["s"]) for r in laid.groupBy("part").agg(F.sum("size").alias("s")).collect())
    before_bytes, n = {}, 0
    for part, s in sums:
        before_bytes[part], n = n, n + s
    placed = settle_table(_in_order(laid, ["doc"], lay, "doc long, begin long, text string", F.lit(False)))
    spread = settle_table(placed.mapInArrow(_spread(length), "pos long, name long, doc long, window binary"))
    ranks = suffix_ranks(spread.select("pos", "name"), n)
    begins = placed.select("doc", "begin")
    windows = spread.where("window IS NOT NULL").join(ranks, "pos").join(begins, "doc").select("rank", "doc", (F.col("pos") - F.col("begin")).alias("start"), "window")
    ordered = _sorted(windows, "rank")

    def neighbours(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        w = t.column("window").to_pylist()
        new = np.array([i == 0 or w[i] != w[i - 1] for i in range(len(w))])
        return new, np.cumsum(new) - 1

    def edges(t: pa.Table) -> pa.Table:
        """First and last window of a partition with their lowest documents."""
        t = t.sort_by("rank")
        new, run = neighbours(t)
        low = np.minimum.reduceat(_column(t, "doc"), np.flatnonzero(new))
        w = t.column("window")
        return pa.table({"part": t.column("part")[:1], "first": w[:1], "first_doc": pa.array([int(low[0])]), "last": w[-1:], "last_doc": pa.array([int(low[-1])]), "one": pa.array([bool(run[-1] == 0)])})

    ends = sorted((r.asDict() for r in ordered.groupBy("part").applyInArrow(edges, "part int, first binary, first_doc long, last binary, last_doc long, one boolean").collect()), key=lambda r: r["part"])
    low_before, low_after = {}, {}  # of the run that goes on over a border; two rows a partition
    for lows, way, edge, other in ((low_before, ends, "first", "last"), (low_after, ends[::-1], "last", "first")):
        window, low = None, _NO_DOC
        for r in way:
            joined = low if r[edge] == window else _NO_DOC
            lows[r["part"]] = joined
            window, low = r[other], min(r[f"{other}_doc"], joined) if r["one"] else r[f"{other}_doc"]

    def pick(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        new, run = neighbours(t)
        doc = _column(t, "doc")
        low = np.minimum.reduceat(doc, np.flatnonzero(new))
        part = t.column("part")[0].as_py()
        low[0] = min(low[0], low_before[part])
        low[-1] = min(low[-1], low_after[part])
        if len(low) == 1:
            low[0] = min(low_before[part], low_after[part], low[0])
        found = doc > low[run]
        return pa.table({"doc_id": doc[found], "start": _column(t, "start")[found]})

    return ordered.groupBy("part").applyInArrow(pick, "doc_id long, start long")


_NO_DOC = np.iinfo(np.int64).max
