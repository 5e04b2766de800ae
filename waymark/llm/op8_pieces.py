"""Operator 8, SentencePiece encoding and decoding of merge-type vocabularies.

A text is normalised as the model says (a leading space, spaces as U+2581) and
cut before each run of spaces.  Within a cut, adjacent symbol pairs that are
vocabulary pieces wait on an agenda ordered by score, then by place; the best
pair is merged until none is left.  Symbols outside the vocabulary become byte
pieces.  No piece of the vocabulary joins a letter to a following space, so
cuts don't change the result (a vocabulary that has such pieces isn't cut).
Cuts are cut again where two characters meet that no piece has side by side.

Results of distinct cuts are kept in a bounded memo.  Every result that enters
it is checked against the sentencepiece library, once an Arrow batch: column
``agrees`` is false for a row of whose batch any cut differed, in ids or in
decoded text.

Defined results: a null or empty text has no ids and decodes to an empty text;
rows are treated one by one, so ties and repeated rows don't matter; an empty
table gives an empty result; other columns are ignored.  A U+2581 in a text is
a space to the model and decodes to one.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .memo import Memo
from .worker import tidy

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


class Codec:
    """Encoder and decoder of one model file, with its memo and the library it is checked against."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in range(size) if not special(i)}
        byte_ids = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_ids, self.unknown = byte_ids, sp.unk_id()
        self.byte_of = {i: b for b, i in byte_ids.items()}
        self.text_of = {i: p.replace(SPACE, " ") for p, (i, _) in self.pieces.items()}
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.joins = {pair for p in self.pieces for pair in zip(p, p[1:], strict=False)}
        self.memo = Memo(self._work)
        self.inner = Memo(self._work_inner)
        self.fresh: list[tuple[str, list[int], str]] = []

    def merge(self, text: str) -> list[int]:
        """Ids of a normalised text by the agenda of adjacent pairs."""
        pieces = self.pieces
        symbols = list(text)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            pair = pieces.get(symbols[i] + symbols[i + 1])
            if pair:
                agenda.append((-pair[1], i, i + 1, symbols[i] + symbols[i + 1]))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, merged = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != merged:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = merged, ""
            following = after[left] = after[right]
            if following >= 0:
                before[following] = left
                joined = merged + symbols[following]
                pair = pieces.get(joined)
                if pair:
                    heapq.heappush(agenda, (-pair[1], left, following, joined))
            preceding = before[left]
            if preceding >= 0:
                joined = symbols[preceding] + merged
                pair = pieces.get(joined)
                if pair:
                    heapq.heappush(agenda, (-pair[1], preceding, left, joined))
        ids: list[int] = []
        for s in symbols:
            if s:
                known = pieces.get(s)
                if known:
                    ids.append(known[0])
                elif self.byte_ids:
                    ids.extend(self.byte_ids[b] for b in s.encode())
                else:
                    ids.append(self.unknown)
        return ids

    def unmerge(self, ids: list[int]) -> str:
        """Text of ids, the leading space of the first piece included; runs of byte pieces decode together."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text_of.get(i, ""))
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def _work(self, key: str) -> tuple[int, str, str]:
        """Of a cut without its first space; parts that can't merge with each other have their own memo entries."""
        joins = self.joins
        at = [k for k, pair in enumerate(zip(key, key[1:], strict=False), 1) if pair not in joins]
        if at:
            parts = [self.memo[key[: at[0]]], *(self.inner[key[a - 1 : b]] for a, b in zip(at, [*at[1:], len(key)], strict=True))]
            return sum([p[0] for p in parts]), ",".join([p[1] for p in parts]), "".join([p[2] for p in parts])
        ids = self.merge(SPACE + key)
        text = self.unmerge(ids)
        self.fresh.append((key, ids, text))
        return len(ids), ",".join(map(str, ids)), text

    def _work_inner(self, key: str) -> tuple[int, str, str]:
        """Of a part after its first letter, which is the end of the part before."""
        ids, before = self.merge(key[1:]), self.merge(SPACE + key[0])
        text = self.unmerge(ids)
        self.fresh.append((key, before + ids, self.unmerge(before) + text))
        return len(ids), ",".join(map(str, ids)), text

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the text they decode to."""
        if not text:
            return 0, "", ""
        whole = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            keys = [whole[1:]]
        elif SPACE * 2 in whole or whole[-1] == SPACE:
            keys = [x[1:] for x in _RUNS.findall(whole)]
        else:
            keys = whole.split(SPACE)[1:]
        found = [self.memo[k] for k in keys]
        return sum([f[0] for f in found]), ",".join([f[1] for f in found]), "".join([f[2] for f in found])[1:]

    def agreed(self) -> bool:
        """Check what was computed since the last call against the library."""
        fresh, self.fresh = self.fresh, []
        if not fresh:
            return True
        keys = [k.replace(SPACE, " ") for k, _, _ in fresh]
        theirs = self.library.encode(keys, num_threads=1)
        theirs = [ids if k else [self.library.piece_to_id(SPACE)] for k, ids in zip(keys, theirs, strict=True)]
        texts = self.library.decode(theirs, num_threads=1)
        return all(ids == other and text[1:] == back for (_, ids, text), other, back in zip(fresh, theirs, texts, strict=True))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _kernel(path: str, with_ids: bool):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            counts, shas, backs, ids, texts = [], [], [], [], []
            for scalar in batch.column("text"):
                n, joined, text = c.encode(scalar.as_py() or "")
                counts.append(n)
                shas.append(sha(joined))
                backs.append(sha(text))
                if with_ids:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                    texts.append(text)
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string()), pa.array([c.agreed()] * len(counts), pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
            if with_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests and ``agrees`` of every row; with ``with_ids`` also ids and decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" + (", ids array<int>, decoded string" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_kernel(model or default_model(), with_ids), schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)
