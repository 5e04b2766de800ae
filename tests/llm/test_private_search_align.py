"""Operators 11 to 13 against brute force and their SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import ENGLISH, TEXTS, by_sql, docs, empty, frame, pandas_docs, sentence  # noqa: F401
from waymark.llm import op4_packing, op8_pieces, op11_private, op12_ranked, op13_align

OP11 = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms"]


def table_of(rows):
    return pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"})


def luhn(s):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(s))) % 10 == 0


def brute_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    return [(name, m.start(), m.end()) for name, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


PRIVATE = [
    "a@b.c@d.e.f a@b.c_x@d.e x..y%+-@-a.-b.c @a.b a@b a@b. a@.b é@a.b.ü zoé.x@a-b.co,", "1.2.3.4.5.6.7.8 255.255.255.255 256.1.1.1 0000255.1.2.000 1.2.3 1..2.3.4 999999999999.1.1.1 1.2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111 4111  1111 abc4111111111111111x 0000000000000", "+1 (017) 555-7713 +49 30 1234 +123456789012345 +1234567890123456 ++12345678901 +1(2) +1 2-3.4)5(6 78 9 +",
    "+1 4111111111111111 10.0.0.1 mail a.b@c.de+49 170 1234567 x", "", None, "日本語 mail@例.jp mail@ex.jp 🎉🎉 10.1.1.1🎉 a@b.cc", "1-" * 400 + "1", "a." * 500 + "@x.y" + ".z" * 300, "1.1" * 200,
]


def test_op11_patterns(spark):
    rows = list(enumerate(PRIVATE))
    rng = random.Random(3)
    rows += [(100 + k, "".join(rng.choice("01259@.+-() aé_x") for _ in range(rng.randint(0, 60)))) for k in range(400)]
    got = {r["doc_id"]: r for r in op11_private.digest(op11_private.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for doc, text in rows:
        want = brute_spans(text)
        s = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert got[doc]["base_sha256"] == hashlib.sha256(s.encode()).hexdigest(), (text, s, got[doc]["spans"])
        assert [got[doc][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(w[0] == k for w in want) for k in ("email", "ip", "card", "phone")]
        assert got[doc]["spans"] == s


def private_rows():
    rng = random.Random(8)
    rows = [(k, sentence(rng, ENGLISH, rng.randint(20, 60))) for k in range(150)]
    for k in range(12):  # a rare name next to one address, in windows of their own
        rows.append((200 + k, sentence(rng, ENGLISH, 30) + f" Ysolde{k % 5} Quarrington writes from yq@mail.example or so " + sentence(rng, ENGLISH, 20)))
    for k in range(30):  # one text copied: a single witness, so its rare words disclose nothing
        rows.append((300 + k, "Copied Xanadumore note of cp@mail.example to all"))
    rows += [(400, "Here Quarrington stands alone, and quarrington@else.example too"), (401, "Ysolde0 is shared by few"), (402, None), (None, "Quarrington"), (403, "yq@mail.example. Quarrington"), (403, "yq@mail.example. Quarrington")]
    return rows


def test_op11_terms(spark, docs, empty):  # noqa: F811
    rows = private_rows()
    frame_of = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = op11_private.digest(op11_private.find(frame_of))
    assert frame(got.select(*OP11).toPandas().astype({"doc_id": "Int64"})) == by_sql(op11_private.SQL, documents=table_of(rows))
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert spans[None] == "term:0:11" and spans[400] == "email:35:59,term:5:16" and spans[300].startswith("email") and "term" not in spans[300]
    clean = {r["doc_id"]: r["clean"] for r in op11_private.sanitise(frame_of).collect()}
    assert "Quarrington" not in " ".join(t for t in clean.values()) and "yq@" not in clean[403] and clean[403] == "[email]. " + ("" if clean[None] == "" else "[email-term]")
    assert clean[0] == rows[0][1] and clean[402] == ""
    awkward = op11_private.digest(op11_private.find(docs))
    assert frame(awkward.select(*OP11).toPandas()) == by_sql(op11_private.SQL, documents=pandas_docs())
    assert op11_private.find(empty).count() == 0 and op11_private.sanitise(empty).count() == 0


def test_op11_beyond_broadcasts(spark, monkeypatch):
    from waymark.llm import common

    rows = private_rows()
    frame_of = spark.createDataFrame(rows, "doc_id long, text string")
    want = frame(op11_private.digest(op11_private.find(frame_of)).toPandas())
    monkeypatch.setattr(op11_private, "PRUNE_PARTS", 2)
    assert frame(op11_private.digest(op11_private.find(frame_of)).toPandas()) == want
    monkeypatch.setattr(op11_private, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert frame(op11_private.digest(op11_private.find(frame_of)).toPandas()) == want


def test_op11_is_native_and_running_sums_hold(spark):
    xs = list(range(1, 300))
    got = spark.createDataFrame([(xs,), ([],), ([5],)], "x array<int>").select(op11_private.running(F.col("x")).alias("r")).collect()
    assert got[0]["r"] == [sum(xs[:k]) for k in range(len(xs))] and got[1]["r"] == [] and got[2]["r"] == [0]


def brute_search(rows, items, k=10):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    docs_terms = [(d, Counter(of(t))) for d, t in rows]
    n_docs, n_all = sum(bool(c) for _, c in docs_terms), sum(c.total() for _, c in docs_terms)
    df = Counter(t for _, c in docs_terms for t in c)
    out = []
    for item, text in items:
        wanted, scored = set(of(text)), []
        for d, c in docs_terms:
            m = 100 - 90 + (90 * c.total() * n_docs) // max(n_all, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_op12(spark, docs, empty, monkeypatch):  # noqa: F811
    rng = random.Random(4)
    items = [(k, sentence(rng, ENGLISH, rng.randint(1, 30))) for k in range(12)] + [(50, None), (51, ""), (52, "nowhere_here?"), (53, "日本語 É bad"), (0, "the of and"), (54, TEXTS[5][1]), (55, "THE the The")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = TEXTS
    want = brute_search(rows, items)
    tuples = lambda df: sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=repr)
    got = op12_ranked.search(docs, bench)
    assert tuples(got) == want
    assert frame(got.drop("n_scored").toPandas()) == by_sql(op12_ranked.SQL, documents=pandas_docs(), benchmark=pd.DataFrame(items, columns=["item_id", "text"]).astype({"text": "string"}))
    monkeypatch.setattr(op12_ranked, "BLOCK_TERMS", 20)  # several blocks of queries
    monkeypatch.setattr(op12_ranked, "SHARD_ENTRIES", 100)  # and many shards
    monkeypatch.setattr(op12_ranked, "STRIDE", 2)
    assert tuples(op12_ranked.search(docs, bench)) == want
    nulls = [(None, "rare word"), (None, "rare word"), (7, "rare word"), (8, "other things here")]
    assert tuples(op12_ranked.search(spark.createDataFrame(nulls, "doc_id long, text string"), spark.createDataFrame([(1, "rare")], "item_id long, text string"))) == brute_search(nulls, [(1, "rare")])
    assert op12_ranked.search(empty, bench).count() == 0 and op12_ranked.search(docs, bench.limit(0)).count() == 0


def test_op12_walk_ends_early_and_is_exact():
    rng = np.random.default_rng(2)
    for trial in range(40):
        n, n_terms = 400, 6
        sizes = rng.integers(0, n_terms + 1, n)
        term = np.concatenate([np.sort(rng.choice(n_terms, s, replace=False)) for s in sizes]).astype(int)
        impact = rng.integers(0, 5, len(term)) if trial % 2 else rng.pareto(1.2, len(term)).astype(np.int64) * 10
        shard = op12_ranked.Shard(rng.permutation(n), np.append(0, np.cumsum(sizes)), term, impact)
        query = np.sort(rng.choice(n_terms, 3, replace=False))
        total = defaultdict(int)
        for d, t, i in zip(np.repeat(np.arange(n), sizes), term, impact, strict=True):
            total[d] += int(i) * (t in query)
        want = sorted(((-s, shard.ids[d]) for d, s in total.items() if s > 0))[:5]
        best, scores, scored = shard.top(query, n_terms, 5)
        assert [(-s, shard.ids[d]) for d, s in zip(best, scores, strict=True)] == want
        if trial == 0:
            assert scored < n


def brute_align(rows):
    """By the libraries and a loop over ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op4_packing.default_tokenizer())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=op8_pieces.default_model())
    letters = op4_packing._byte_letters()
    made, counts = [], Counter()
    for doc, text in rows:
        a = b = []
        if text:
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(letters[c] for c in t.id_to_token(i)) if i < 50256 else b"<|endoftext|>" for i in a]
        pieces = [sp.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(p[3:-1], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            a, b, bytes_a, bytes_b = [], [], [], []
        groups, links, i, j, at_a, at_b, held = [], [], 0, 0, 0, 0, ([], [])
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += len(bytes_a[i])
                held[0].append(a[i])
                i += 1
            else:
                at_b += len(bytes_b[j])
                held[1].append(b[j])
                j += 1
            if at_a == at_b:
                links.append((held[0][-1], held[1][-1]))
                groups.append(held)
                held = ([], [])
        counts.update(links)
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        made.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(spelled.encode()).hexdigest() if a else ""))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted([(d, na, nb, g, len(ls), sum(counts[x] == best[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for d, na, nb, g, ls, sha in made], key=repr)


OP13 = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op13(spark, docs, empty):  # noqa: F811
    rng = random.Random(6)
    own = [(900, "<|endoftext|> in a text </s><s><unk> <0x41>"), (901, "a▁b"), (902, "  two  spaces "), (903, "\n\n tab\tx\r\n"), (904, " "), (905, "🎉é\x00\x7f"), (None, "null id"), (906, "résumé naïve ﬁ ＡＢＣ"), (907, "x" * 3000)]
    own += [(1000 + k, "".join(rng.choice("ab é.\n<|>_日🎉0 ") for _ in range(rng.randint(1, 40)))) for k in range(150)]
    small = spark.createDataFrame(own, "doc_id long, text string").repartition(3)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + own
    got = op13_align.align_corpus(docs.select("doc_id", "text").unionByName(small))
    want = brute_align(rows)
    assert sorted([tuple(r[c] for c in OP13) for r in got.collect()], key=repr) == want
    blocks = op13_align.align_corpus(docs.select("doc_id", "text").unionByName(small), block=50)  # counts broadcast in blocks
    assert sorted([tuple(r[c] for c in OP13) for r in blocks.collect()], key=repr) == want
    assert op13_align.align_corpus(empty).count() == 0


def test_op13_links_expand_shared_ends():
    cuts, group_a, group_b, link_a, link_b = op13_align.align(np.array([2, 2, 5, 7]), np.array([2, 4, 5, 5, 7]))
    assert cuts.tolist() == [2, 5, 7] and group_a.tolist() == [0, 0, 1, 2] and group_b.tolist() == [0, 1, 1, 1, 2]
    assert list(zip(link_a.tolist(), link_b.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 2), (2, 3), (3, 4)]


def test_terms_are_the_same_runs_everywhere():
    text = "É_a-B9 ÿ\x7f~日本{x}`y´z"
    hashes, at = op12_ranked.terms(pa.array([text, None, "b9 b9"]))
    assert at.tolist() == [0, 7, 7, 9] or len(hashes) == at[-1]
    assert hashes[at[2]] == hashes[at[2] + 1]
