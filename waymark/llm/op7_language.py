"""Operator 7, language identification with spans.

Words are scored per language by hashed character n-grams.  Words are
runs without white space; in scripts that don't part words (Han, Kana, Thai, Lao,
Tibetan, Burmese, Khmer) runs of one script are cut into words of ``RUN`` characters.
The script of a word narrows the languages that it may be in: the others are no
candidates for it, however few its letters; Viterbi over the words, with a
penalty for each switch, labels spans of one language.  A document's language
is the one with most letters; its score is the share of letters under that
label times its posterior over the whole text.

The model is fitted on documents that have a language and whose
``crc32(doc_id as text) mod 4`` isn't 2: per language a sample of about
``PER_LANGUAGE`` documents, drawn by a hash of the id (all, if there are fewer).
It has ``BUCKETS`` numbers a language, whatever the input.

Defined results: a null text, or one without letters, is ``und`` with score 0;
so is every text if nothing could be learned; a null id counts as remainder 0;
of equally likely languages the first by name is taken; repeated rows are
judged one by one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import mix, pieces
from .common import table
from .worker import tidy

PER_LANGUAGE = 2000
BUCKETS = 1 << 16
PENALTY = 10.0
MIN_SCRIPT_SHARE = 0.05
#: A word, such as a key or an address, counts for no more than this.
MAX_LOSS, MAX_LETTERS = 8.0, 15
UNKNOWN = "und"
#: Characters of a word in a script without spaces; a cut of the text into words, not of the text.
RUN = 4
#: What a word takes from a language that its script excludes, on the way to spans.
EXCLUDED = 1e4
_KNOWN_WORDS = 100_000

#: Script ranges (first code point, last, script); letters elsewhere have script 0.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1E00, 0x1EFF, "Latin"),
    (0x3040, 0x30FF, "Kana"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
_NAMES = ["", *dict.fromkeys(s[2] for s in SCRIPTS)]
_STARTS = np.array([s[0] for s in SCRIPTS])
_ENDS = np.array([s[1] for s in SCRIPTS])
_OF = np.array([_NAMES.index(s[2]) for s in SCRIPTS])


_UNSPACED = (
    "\u3005-\u3007\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff", "\u3040-\u30ff\u31f0-\u31ff\uff66-\uff9f",  # Han, Kana
    "\u0e00-\u0e7f", "\u0e80-\u0eff", "\u0f00-\u0fff", "\u1000-\u109f", "\u1780-\u17ff",  # Thai, Lao, Tibetan, Burmese, Khmer
)
_ANY_UNSPACED = re.compile(f"[{''.join(_UNSPACED)}]")
_WORDS = re.compile("|".join([*(f"[{x}]{{1,{RUN}}}" for x in _UNSPACED), rf"[^\s{''.join(_UNSPACED)}]+"]))


def split_words(text: str | None) -> list[str]:
    """The words of a text, which spans count: runs without white space, cut further in scripts without spaces."""
    words = (text or "").split()
    if not text or text.isascii() or not _ANY_UNSPACED.search(text):
        return words
    return [part for w in words for part in (_WORDS.findall(w) if _ANY_UNSPACED.search(w) else (w,))]


def _letters(token: str) -> str:
    token = token.lower()
    return token if token.isalpha() else "".join([c for c in token if c.isalpha()])


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all 1- to 3-grams of bracketed words, the word of each, and script and letters of each word."""
    text = "".join([f"\x02{w}\x03" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), size)
    ids, owner = [], []
    for n, mark in ((1, 0x51), (2, 0x52), (3, 0x53)):
        k = len(code) - n + 1
        if k <= 0:
            continue
        h = np.full(k, mark, np.uint64)
        for j in range(n):
            h = h * np.uint64(1_000_003) + code[j : j + k]
        own = word[:k] == word[n - 1 :]
        ids.append((mix(h[own]) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(word[:k][own])
    at = np.searchsorted(_STARTS, code, "right") - 1
    script = np.where((at >= 0) & (code <= _ENDS[at]), _OF[at], 0)
    counts = np.bincount(word * len(_NAMES) + script, minlength=len(words) * len(_NAMES)).reshape(-1, len(_NAMES))
    counts[:, 0] = 0
    return np.concatenate(ids), np.concatenate(owner), counts.argmax(1), size - 2


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language the weights of n-gram buckets, then of scripts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in pieces(batch, "text"):
            tokens: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text"), strict=True):
                tokens.setdefault(lang, Counter()).update(split_words(text.as_py()))
            for lang, counter in tokens.items():
                words = [_letters(t) for t in counter]
                times = np.fromiter(counter.values(), np.float64, len(counter))
                if not words:
                    continue
                ids, owner, script, letters = _grams(words)
                grams = np.bincount(ids, times[owner] * (letters[owner] > 0), BUCKETS)
                scripts = np.bincount(script, times * letters, len(_NAMES))
                sums[lang] = sums.get(lang, 0) + np.concatenate([grams, scripts])
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["lang", "sums"])


@tidy
def _add(group: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x) for x in group.column("sums").to_pylist()], axis=0)
    return pa.table({"lang": group.column("lang")[:1], "sums": pa.array([total.tobytes()], pa.binary())})


def _remainder():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4


class Model:
    """Languages, log-probabilities of n-gram buckets [bucket, language], and scripts of each language."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.languages = sorted(sums)
        rows = np.stack([sums[x] for x in self.languages]) if sums else np.zeros((0, BUCKETS + len(_NAMES)))
        grams, scripts = rows[:, :BUCKETS] + 0.5, rows[:, BUCKETS:]
        self.scores = np.log(grams / grams.sum(1, keepdims=True)).T.astype(np.float32)
        allowed = scripts >= MIN_SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
        allowed[:, 0] = True
        allowed[:, ~(allowed & (scripts > 0)).any(0)] = True  # a script of no language narrows nothing
        self.narrow = np.where(allowed.T, 0.0, -EXCLUDED).astype(np.float32)
        self._known: dict[str, int] = {}
        self._table = np.zeros((0, len(self.languages)), np.float32)
        self._letters = np.zeros(0, np.int64)

    def __getstate__(self):
        return {"languages": self.languages, "scores": self.scores, "narrow": self.narrow}

    def __setstate__(self, state):
        self.__dict__.update(state, _known={}, _table=np.zeros((0, len(state["languages"])), np.float32), _letters=np.zeros(0, np.int64))

    def of_tokens(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores [token, language], -EXCLUDED where the script rules a language out, and letters of each token; distinct words are scored once and kept for a while."""
        if not self.languages:
            return np.zeros((len(tokens), 0), np.float32), np.zeros(len(tokens), np.int64)
        if len(self._known) > _KNOWN_WORDS:
            self._known, self._table, self._letters = {}, self._table[:0], self._letters[:0]
        new = list(set(tokens).difference(self._known))
        if new:
            ids, owner, script, letters = _grams([_letters(t) for t in new])
            scores = np.stack([np.bincount(owner, self.scores[ids, k], len(new)) for k in range(len(self.languages))], 1)
            scores += self.narrow[script]
            scores -= scores.max(1, keepdims=True, initial=-np.inf)
            out = (self.narrow[script] < 0) & (scores < 0)
            scores = np.where(out, np.float32(-EXCLUDED), np.maximum(scores, -MAX_LOSS))
            scores = np.where(letters[:, None] > 0, scores, 0).astype(np.float32)
            letters = np.minimum(letters, MAX_LETTERS)
            self._known.update(zip(new, range(len(self._known), len(self._known) + len(new)), strict=True))
            self._table, self._letters = np.concatenate([self._table, scores]), np.concatenate([self._letters, letters])
        k = np.fromiter(map(self._known.__getitem__, tokens), np.int64, len(tokens))
        return self._table[k], self._letters[k]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word when every switch costs ``penalty``."""
    lead = int(scores.sum(0, dtype=np.float64).argmax())
    gain = np.cumsum(scores - scores[:, lead : lead + 1], axis=0, dtype=np.float64)
    floor = np.minimum.accumulate(np.vstack([np.zeros((1, scores.shape[1])), gain[:-1]]), axis=0)
    ends = gain.max() + (gain[-1] - np.vstack([gain[:1] * 0, gain[:-1]])).max()
    # No run of words gains a switch, so the lead isn't left in between; a path without it has a switch less than runs,
    # but its first and last run together gain no switch: one language is the best path.
    if (gain - floor).max() <= penalty and ends <= penalty:
        return np.full(len(scores), lead)
    best, back = [0.0] * scores.shape[1], []
    for row in scores.tolist():
        top = max(best)
        j, stay = best.index(top), top - penalty
        back.append([k if v >= stay else j for k, v in enumerate(best)])
        best = [(v if v >= stay else stay) + s for v, s in zip(best, row, strict=True)]
    path = np.empty(len(scores), np.int64)
    k = best.index(max(best))
    for t in range(len(scores) - 1, -1, -1):
        path[t] = k
        k = back[t][k]
    return path


def label(model: Model, tokens: list[str], scores: np.ndarray, letters: np.ndarray, penalty: float, with_spans: bool):
    """Language, score and (first word, end, language) spans of one text."""
    if not letters.sum() or not model.languages:
        return UNKNOWN, 0.0, []
    path = viterbi(scores, penalty)
    per = np.bincount(path, letters, len(model.languages))
    k = int(per.argmax())
    total = np.maximum(scores, -MAX_LOSS).sum(0, dtype=np.float64)  # a few foreign words don't rule out the text's language
    posterior = 1 / np.exp(np.minimum(total - total[k], 700)).sum()
    spans = []
    if with_spans:
        cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        spans = [{"begin": a, "end": b, "lang": model.languages[path[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
    return model.languages[k], float(per[k] / per.sum() * min(posterior, 1.0)), spans


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """The model learned from a bounded sample of the labelled documents that aren't held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder() != 2))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model({})
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, per_language / n)])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col("lang")]).select("lang", "text")
    sums = sample.mapInArrow(_count, "lang string, sums binary").groupBy("lang").applyInArrow(_add, "lang string, sums binary")
    return Model({r["lang"]: np.frombuffer(r["sums"]) for r in sums.collect()})


def identify(docs: DataFrame, penalty: float = PENALTY, with_spans: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and spans of words) of every row of ``docs`` (doc_id, text, lang).

    With ``carry``, column ``row`` has all columns of the row.
    """
    id_, text = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    row = [F.struct(*[text if c == "text" else docs[c] for c in docs.columns]).alias("row")] if carry else []
    given = docs.select(id_, (_remainder() == 2).alias("held_out"), *(row or [text]))  # a text goes to Python once
    row_type = f", row {given.schema['row'].dataType.simpleString()}" if carry else ""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if carry:
                batch = batch.append_column("text", batch.column("row").field("text"))
            for part in pieces(batch, "text"):
                texts = [split_words(t.as_py()) for t in part.column("text")]
                scores, letters = model.of_tokens([w for t in texts for w in t])
                found, at = [], 0
                for t in texts:
                    end = at + len(t)
                    found.append(label(model, t, scores[at:end], letters[at:end], penalty, with_spans))
                    at = end
                columns = [part.column("doc_id"), part.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                names = ["doc_id", "held_out", "lang_pred", "score"]
                if with_spans:
                    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
                    columns.append(pa.array([f[2] for f in found], kind))
                    names.append("spans")
                if carry:
                    columns.append(part.column("row"))
                    names.append("row")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, held_out boolean, lang_pred string, score double" + (", spans array<struct<begin:int,end:int,lang:string>>" if with_spans else "")
    return given.mapInArrow(run, schema + row_type)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"), with_spans=False)
