"""Operator 13, alignment of two tokenizers over the corpus.

Both tokenizations of a document spell the same bytes, so cumulative sums of
their tokens' byte lengths are where tokens end.  Ends common to both
(``intersect1d``) cut the document into groups; ``searchsorted`` tells each
token its group.  Tokens A and B are linked where their byte ranges end
together; ends are expanded by ``repeat``, so an end that several tokens share
would link them all.  Links are counted a pair of ids in two stages, first by
pair and salt, and each document then sums up the counts of its own links.

A is byte-level BPE of a space and the text, B a merge-type SentencePiece
vocabulary, which puts the space itself.  Special tokens' strings in a text are
plain text.  Distinct words are encoded once while a bounded memo has them.

Defined results: a null or empty text, and one that a tokenization doesn't give
back byte by byte (U+2581 is a space to B), has no tokens: zeros and an empty
digest.  Rows are aligned one by one, equal rows alike and counted each; null
ids don't matter; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays
from .common import settle, settle_table, table
from .op4_packing import Ids, default_tokenizer
from .op8_pieces import SPACE, Codec, default_model
from .worker import tidy

COUNT_SALTS = 32
#: Pairs whose counts are broadcast at a time (about 24 bytes each); more are taken in blocks by their hash.
BLOCK_PAIRS = 1_000_000
_NONE = np.zeros(0, np.int64)


class Vocabularies:
    """Ids and bytes of both tokenizers; special tokens' strings are plain text to A.

    A text whose spaces stand alone is encoded word by word, each with the space
    before it, as neither tokenizer joins a letter to a following space
    (``cuts``).  A batch's distinct words that the memo lacks are encoded together.
    """

    def __init__(self, path_a: str, path_b: str, limit: int = 20_000, longest: int = 64):
        coder, pieces = Ids(path_a), Codec(path_b)
        self.encode_a, self.library, self.cuts = coder.encoding.encode_ordinary, pieces.library, pieces.cuts
        n = coder.encoding.max_token_value + 1
        self.bytes_a, self.bytes_b = [b""] * n, [self.library.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.library.get_piece_size())]
        for token in coder.encoding.token_byte_values():
            self.bytes_a[coder.encoding.encode_single_token(token)] = token
        for i, b in pieces.byte_of.items():
            self.bytes_b[i] = bytes([b])
        self.limit, self.longest = limit, longest
        self.memo: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def forget(self) -> None:
        self.memo, self.old = {}, {}

    def _whole(self, text: str) -> bool:
        return not self.cuts or text[0] == " " or text[-1] == " " or "  " in text

    def of_texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids A and B of each text; none if the text is empty or one of the two doesn't give it back."""
        known = [t if SPACE not in t else "" for t in texts]
        words = [t.split(" ") if t and not self._whole(t) else [] for t in known]
        ids = self._learn(set().union(*words))
        for text, mine in zip(known, words, strict=True):
            if not text:
                yield _NONE, _NONE
                continue
            if mine:
                both = [ids[w] for w in mine]
                if all(both):
                    a, b = (np.frombuffer(b"".join([x[k] for x in both]), np.uint32).astype(np.int64) for k in (0, 1))
                    yield a, b
                else:
                    yield _NONE, _NONE
            else:
                a, b = self.encode_a(" " + text), self.library.encode(text, num_threads=1)
                yield (np.array(a, np.int64), np.array(b, np.int64)) if self._spell(a, b, text) else (_NONE, _NONE)

    def _spell(self, a: list[int], b: list[int], text: str) -> bool:
        """Whether both give a space and the text."""
        raw = b" " + text.encode()
        return all(b"".join([of[i] for i in ids]) == raw for ids, of in ((a, self.bytes_a), (b, self.bytes_b)))

    def _learn(self, words: set[str]) -> dict[str, tuple]:
        """The ids of all ``words`` as 32-bit bytes, nothing for a word that isn't given back; two generations of at most ``limit`` short words stay for later."""
        found, fresh = {}, []
        for w in words:
            ids = self.memo.get(w)
            if ids is None:
                ids = self.old.get(w)
            if ids is None:
                fresh.append(w)
            else:
                found[w] = ids
        if fresh:
            of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
            for w, b in zip(fresh, self.library.encode(fresh, num_threads=1), strict=True):
                a = self.encode_a(" " + w)
                same = b"".join(map(of_a, a)) == b"".join(map(of_b, b)) == b" " + w.encode()
                found[w] = (array("I", a).tobytes(), array("I", b).tobytes()) if same else ()
        if len(self.memo) + len(found) > self.limit:
            self.old, self.memo = self.memo, {}
        self.memo.update((w, ids) for w, ids in found.items() if len(w) <= self.longest)
        return found


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From sorted ends: the common cuts, the group of each token A and B, and of all links the places in A and in B."""
    distinct = all((np.diff(e) > 0).all() for e in (ends_a, ends_b))
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=distinct)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    first_a, n_a = np.searchsorted(ends_a, cuts), np.searchsorted(ends_a, cuts, "right")
    first_b, n_b = np.searchsorted(ends_b, cuts), np.searchsorted(ends_b, cuts, "right")
    n_a, n_b = n_a - first_a, n_b - first_b
    n = n_a * n_b  # one, as tokens have bytes; tokens without any would share ends
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(n_b, n)
    return cuts, group_a, group_b, np.repeat(first_a, n) + k // width, np.repeat(first_b, n) + k % width


def spelled(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> str:
    """``a1,a2|b1;a3|b2,b3``: decimal ids of each group in order."""
    label = np.concatenate([2 * group_a, 2 * group_b + 1])
    order = np.argsort(label, kind="stable")
    label, ids = label[order], np.concatenate([a, b])[order]
    last = np.append(label[1:] != label[:-1], True)
    mark = np.where(last, 1 + label % 2, 0)
    codes = 3 * ids + mark
    while len(_names) <= codes.max(initial=0):
        _names.extend(f"{len(_names) // 3}{m}" for m in ",|;")
    return "".join(map(_names.__getitem__, codes.tolist()))[:-1]


#: Decimal ids, each with the three marks that may follow.
_names: list[str] = []


_vocabularies: dict[tuple[str, str], Vocabularies] = {}


class Aligner:
    """Tokens and links of single texts."""

    def __init__(self, path_a: str, path_b: str):
        if (path_a, path_b) not in _vocabularies:
            _vocabularies[path_a, path_b] = Vocabularies(path_a, path_b)
        self.tokens = _vocabularies[path_a, path_b]
        self.len_a, self.len_b = (np.array([len(x) for x in of]) for of in (self.tokens.bytes_a, self.tokens.bytes_b))

    def rows(self, texts: list[str]) -> Iterator[tuple]:
        """Of each text n_a, n_b, n_groups, n_links, distinct pairs (A id * 2**32 + B id) with their links, and the digest."""
        for a, b in self.tokens.of_texts(texts):
            if not len(a):
                yield 0, 0, 0, 0, _NONE, _NONE, ""
                continue
            cuts, group_a, group_b, link_a, link_b = align(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
            pairs, n = np.unique((a[link_a] << 32) + b[link_b], return_counts=True)
            digest = hashlib.sha256(spelled(a, b, group_a, group_b).encode()).hexdigest()
            yield len(a), len(b), len(cuts), len(link_a), pairs, n, digest


def _kernel(path_a: str, path_b: str):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for part in arrays.pieces(batch, "text"):
                rows = aligner.rows([x.as_py() or "" for x in part.column("text")])
                n_a, n_b, n_groups, n_links, pairs, times, digests = zip(*rows, strict=True)
                cuts = pa.array(np.append(0, np.cumsum([len(p) for p in pairs])), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
                counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])
        aligner.tokens.forget()  # the worker stays, later stages need the memory

    return run


def aligned(docs: DataFrame, tokenizer: str | None = None, model: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and distinct linked ``pairs`` with how many ``times`` each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return rows.mapInArrow(_kernel(tokenizer or default_tokenizer(), model or default_model()), schema)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, its ``count`` of links over the corpus, and whether that is its B id's highest (``best``)."""
    each = links.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"), F.pmod(F.monotonically_increasing_id(), F.lit(COUNT_SALTS)).cast("int").alias("salt"))
    salted = each.groupBy(F.col("p.pairs").alias("pair"), "salt").agg(F.sum("p.times").alias("n"))
    counts = settle(salted.groupBy("pair").agg(F.sum("n").alias("count")))
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # at most one row a piece of the vocabulary
    joined = counts.withColumn("b", b).join(F.broadcast(highest), "b")
    return settle(joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best")))


def with_counts(links: DataFrame, counts: DataFrame, block: int = BLOCK_PAIRS) -> DataFrame:
    """``links`` (settled, with ``row_id``) with n_best and count_sum over each row's links.

    Counts are broadcast, at most about ``block`` pairs at a time, each block
    against all links; a row's sums are made inside its map task.
    """
    n_blocks = max(1, -(-counts.count() // block))
    each = links.select("row_id", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row_id", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    found = None
    for k in range(n_blocks):
        mine = F.pmod(F.xxhash64("pair"), F.lit(n_blocks)) == k
        joined = each.where(mine).join(F.broadcast(counts.where(mine)), "pair")
        part = joined.select("row_id", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy("row_id").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = links.select("row_id", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "row_id", "left").drop("row_id")
    return rows.fillna(0, ["n_best", "count_sum"])


def align_corpus(docs: DataFrame, tokenizer: str | None = None, model: str | None = None, block: int = BLOCK_PAIRS) -> DataFrame:
    """Per document its tokens, groups and links, n_best and count_sum, and the digest of its groups."""
    links = settle_table(aligned(docs, tokenizer, model).withColumn("row_id", F.monotonically_increasing_id()))
    return with_counts(links, pair_counts(links), block)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = align_corpus(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
