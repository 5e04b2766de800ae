"""Operator 12, ranked lexical search by Fagin's threshold algorithm.

Documents lie in shards of bounded size.  A shard holds, for the terms that the
queries use, one list of documents by falling impact a term, and a forward
index with all terms of a document.  A query walks its lists in turn,
``STRIDE`` entries of each a round; a document seen for the first time gets its
whole score by a lookup in the forward index.  The threshold is what a document
could still score that is on none of the entries read: the sum of the impacts
where the lists stand.  The walk ends when it is strictly below the kth best
score, as a document that ties with it may have the smaller id.  The best k of
all shards are ranked together.

The whole corpus is counted first (documents, terms, documents a term).
Queries are taken in blocks of at most ``BLOCK_TERMS`` distinct terms, each
against all documents.

Defined results: a null text has no terms and is found by no query; a null or
empty query finds nothing; every query row has its own ranks, also if item ids
repeat; documents of equal score come by ascending id, null ids last, repeated
rows side by side; empty tables give an empty result; other columns are
ignored.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays
from .common import drop_table, settle_table, table
from .worker import tidy

TOP = 10
BLOCK_TERMS = 50_000
SHARD_ENTRIES = 2_000_000
STRIDE = 32
MERGE_SALTS = 64

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NO_ID = np.iinfo(np.int64).max


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of all rows, and where each row's begin (with the end last)."""
    raw, at = arrays.text_bytes(column)
    buf = _LOWER[raw]
    solid = _TERM[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[at] = True
    before, after = np.ones(len(buf), bool), np.ones(len(buf), bool)
    before[1:] = ~solid[:-1]
    after[:-1] = ~solid[1:]
    begin = np.flatnonzero(solid & (before | edge[:-1]))
    end = np.flatnonzero(solid & (after | edge[1:])) + 1
    return arrays.spans_hash(arrays.rolling(buf), begin, end), np.searchsorted(begin, at)


def _index(vocabulary: np.ndarray):
    """Kernel: per document its number of terms, and of the vocabulary's terms their numbers and occurrences."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.pieces(batch, "text"):
                found, at = terms(part.column("text"))
                if not len(vocabulary):
                    which, hit = np.zeros(0, np.int64), np.zeros(len(found), bool)
                else:
                    which = np.minimum(np.searchsorted(vocabulary, found), len(vocabulary) - 1)
                    hit = vocabulary[which] == found
                    which = which[hit]
                row = np.repeat(np.arange(part.num_rows), np.diff(at))[hit]
                code, tf = np.unique(row * max(len(vocabulary), 1) + which, return_counts=True)
                row, term = np.divmod(code, max(len(vocabulary), 1))
                cuts = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(np.diff(at), pa.int64()),
                        pa.ListArray.from_arrays(cuts, pa.array(term, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tf, pa.int64())),
                    ],
                    ["doc_id", "n", "terms", "tfs"],
                )

    return run


def forward_index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, number of terms ``n``, and the vocabulary's ``terms`` (numbers) in the document with their ``tfs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_index(vocabulary), "doc_id long, n long, terms array<int>, tfs array<long>")


class Shard:
    """Impact-sorted lists and forward index over the documents of one shard."""

    def __init__(self, ids: np.ndarray, cuts: np.ndarray, term: np.ndarray, impact: np.ndarray):
        self.ids, self.cuts, self.term, self.impact = ids, cuts, term, impact
        doc = np.repeat(np.arange(len(ids)), np.diff(cuts))
        order = np.lexsort((-impact, term))
        self.list_doc, self.list_impact = doc[order], impact[order]
        self.list_terms, self.list_at = np.unique(term[order], return_index=True)
        self.list_at = np.append(self.list_at, len(order))

    def _score(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of documents, from the forward index."""
        sizes = self.cuts[docs + 1] - self.cuts[docs]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.cuts[docs] - (ends - sizes), sizes)
        gains = np.concatenate([[0], np.cumsum(np.where(wanted[self.term[at]], self.impact[at], 0))])
        return gains[ends] - gains[ends - sizes]

    def top(self, query: np.ndarray, n_terms: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Of the best ``k`` documents the numbers and scores above 0, best first, and how many documents were scored."""
        at = np.searchsorted(self.list_terms, query)
        here = at < len(self.list_terms)
        here[here] = self.list_terms[at[here]] == query[here]
        begin, end = self.list_at[at[here]], self.list_at[at[here] + 1]
        wanted = np.zeros(n_terms, bool)
        wanted[query] = True
        seen = np.zeros(len(self.ids), bool)
        best, scores, depth = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        n_scored = 0
        while len(begin):
            depth += STRIDE
            stop = np.minimum(begin + depth, end)
            start = np.minimum(begin + depth - STRIDE, end)
            n = stop - start
            read = np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)
            fresh = np.unique(self.list_doc[read])
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            n_scored += len(fresh)
            best, scores = np.concatenate([best, fresh]), np.concatenate([scores, self._score(fresh, wanted)])
            order = np.lexsort((self.ids[best], -scores))[:k]
            best, scores = best[order], scores[order]
            open_lists = stop < end
            threshold = self.list_impact[stop[open_lists] - 1].sum()  # an exhausted list has nothing more to give
            if threshold <= 0 or len(best) == k and threshold < scores[-1]:
                break
        keep = scores > 0
        return best[keep], scores[keep], n_scored


def impacts(term: np.ndarray, tf: np.ndarray, n: np.ndarray, weights: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """A term's share of a document's score: 64-bit integers, divisions rounded down."""
    m = 100 - 90 + (90 * n * n_docs) // max(n_all, 1)
    return weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _search(queries: list[np.ndarray], weights: np.ndarray, n_docs: int, n_all: int, k: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def answers() -> pa.RecordBatch:
            ids, sizes, term, tf, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            shard = Shard(ids, np.append(0, np.cumsum(sizes)), term, impacts(term, tf, np.repeat(n, sizes), weights, n_docs, n_all))
            rows: list[tuple[np.ndarray, ...]] = []
            for item, query in enumerate(queries):
                best, scores, scored = shard.top(query, len(weights), k)
                rows.append((np.full(len(best), item), shard.ids[best], scores, np.full(len(best), scored)))
            item, doc, score, scored = (np.concatenate(x) for x in zip(*rows, strict=True))
            doc = pa.array(doc, pa.int64(), mask=doc == _NO_ID)
            return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), doc, pa.array(score, pa.int64()), pa.array(scored, pa.int64())], ["item", "doc_id", "score", "n_scored"])

        entries = 0
        for batch in batches:
            lists, counts = batch.column("terms"), batch.column("tfs")
            sizes = np.diff(lists.offsets.to_numpy())
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(_NO_ID).to_numpy()
            held.append((ids, sizes, lists.flatten().to_numpy(), counts.flatten().to_numpy(), batch.column("n").to_numpy()))
            entries += int(sizes.sum()) + len(ids)
            if entries >= SHARD_ENTRIES:
                yield answers()
                entries = 0
        if held:
            yield answers()

    return run


def _blocks(items: DataFrame, id_column: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Query ids and their distinct term hashes, in blocks of at most ``BLOCK_TERMS`` terms (one query at least)."""
    ids: list = []
    texts: list[np.ndarray] = []
    size = 0
    for row in items.select(id_column, F.col("text").cast("string").alias("text")).toLocalIterator():
        found = np.unique(terms(pa.array([row["text"]], pa.string()))[0])
        if ids and size + len(found) > BLOCK_TERMS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row[id_column])
        texts.append(found)
        size += len(found)
    if ids:
        yield ids, texts


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_column: str = "item_id") -> DataFrame:
    """The ``k`` best documents of every query row of ``items``: item_id, rank, doc_id, score, n_scored (documents scored in its shard)."""
    spark, out = docs.sparkSession, None
    id_type = items.schema[id_column].dataType
    for ids, queries in _blocks(items, id_column):
        vocabulary = np.unique(np.concatenate(queries))
        index = settle_table(forward_index(docs, vocabulary))
        total = index.agg(F.sum((F.col("n") > 0).cast("long")).alias("n_docs"), F.sum("n").alias("n_all")).first()
        n_docs, n_all = total["n_docs"] or 0, total["n_all"] or 0
        df = np.zeros(len(vocabulary), np.int64)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most one row a term of the block
            df[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        numbers = [np.searchsorted(vocabulary, q) for q in queries]
        best = index.where("size(terms) > 0").select("doc_id", "n", "terms", "tfs").mapInArrow(_search(numbers, weights, n_docs, n_all, k), "item int, doc_id long, score long, n_scored long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(MERGE_SALTS)).cast("int")
        few = best.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, {id_column} {id_type.simpleString()}")
        found = settle_table(ranked.join(F.broadcast(names), "item").select(id_column, "rank", "doc_id", "score", "n_scored"))
        drop_table(index)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return items.limit(0).select(id_column, F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("n_scored"))
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_SQL_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_SQL_TERMS} AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_all FROM d),
q AS (SELECT DISTINCT item, item_id, term FROM (SELECT row_number() OVER () AS item, item_id, unnest({_SQL_TERMS}) AS term FROM benchmark)),
p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
s AS (SELECT item, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * (SELECT n_docs FROM c)) // (SELECT n_all FROM c)))))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY item, item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
