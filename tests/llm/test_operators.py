"""Every operator on a small table of awkward rows, against brute force or its SQL."""

import hashlib
import json
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from waymark.llm import common, components, op1_quality, op2_repeats, op3_urls, op4_packing, op5_media, op6_jaccard, op7_language, op8_pieces, op9_chat, op10_html, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, bucket int, row string, host string, length int, token string, bits int, _salt int"
ENGLISH = "the of and to in is that was for it with as his on be at by had not are but from or have an they which one you were".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()
GREEK = "και το να του της με για από στο που είναι τον την θα δεν τα οι μια ένα όπως αυτό".split()


def sentence(rng, words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def make_docs():
    rng = random.Random(7)
    passage = "This passage of more than fifty bytes stands in several documents, and ends here."
    base = sentence(rng, ENGLISH, 120)
    near = base.split()
    near[60] = "changed"
    texts = [
        (None, "en"), ("", "en"), (" \n\t ", None), ("word", "en"), ("12 34 !!", "en"), (base, "en"), (base, "en"), (" ".join(near), "en"), (base.upper(), "en"),
        (sentence(rng, ENGLISH, 30) + passage + sentence(rng, ENGLISH, 30), "en"), (passage, "en"), (sentence(rng, GERMAN, 40) + "\n" + passage + " tail", "de"),
        ("The " * 3000, "en"), ("same line\n" * 40, "en"), (sentence(rng, ENGLISH, 20_000), "en"), ("日本語 🎉 é " * 30, "ja"), ("a" * 49, "en"), ("a" * 50, "en"), ("a" * 60, None),
    ]
    texts += [(sentence(rng, words, rng.randint(25, 90)), lang) for words, lang in ((ENGLISH, "en"), (GERMAN, "de"), (GREEK, "el")) for _ in range(30)]
    rows = [(k, t, lang, ("hot", "other", None, "bad")[0 if k % 3 == 0 else k % 4], None if t is None else len(t)) for k, (t, lang) in enumerate(texts)]
    rows += [(5, base, "en", "hot", len(base)), (200, "bad text", "en", "bad", 8), (201, "bad bad", "en", "bad", 7), (202, "worse", "en", "bad", 5)]  # a repeated row, a failing host
    return [(*r, 1, "x", 2, "y", "z", 3, "t", 4, 5) for r in rows]


ROWS = make_docs()
TEXTS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def frame(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


def by_sql(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, rows)
    return frame(con.sql(sql).df())


def pandas_docs(rows=ROWS):
    return pd.DataFrame([r[:5] for r in rows], columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "int64", "text": "string", "source": "string"})


OP1 = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def test_op1(spark, docs, empty):
    got = op1_quality.judge(docs)
    assert frame(got.select(*OP1).toPandas()) == by_sql(op1_quality.SQL, documents=pandas_docs())
    bad = got.where("host = 'bad'").toPandas()
    assert bad.base_failed.any() and got.where("kept AND base_failed").count() == 0
    few = docs.where("doc_id IN (5, 30, 31) OR doc_id >= 200").withColumn("source", F.when(F.col("doc_id") >= 30, "bad").otherwise("good"))
    assert {r["doc_id"] for r in op1_quality.judge(few, max_host_rate=0.3).where("kept").collect()} == {5}
    assert op1_quality.judge(empty).count() == 0
    assert op1_quality.judge(docs, carry=True).select("row.*").columns == docs.columns


def brute_repeats(rows):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < doc:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_op2(spark, docs, empty):
    got = op2_repeats.remove_repeats(docs)
    rows = sorted(tuple(r)[:5] for r in got.collect())
    assert rows == brute_repeats(TEXTS)
    kept = {r["doc_id"]: r["kept_text"] for r in got.collect()}
    assert "stands in several documents" in kept[9] and kept[11].endswith(" tail") and "stands in several" not in kept[11]
    assert op2_repeats.remove_repeats(empty).count() == 0
    carried = op2_repeats.remove_repeats(docs, carry=True).select("row.*").columns
    assert carried == [c for c in docs.columns if c != "text"]


def test_op2_on_random_bytes_and_shared_ids(spark):
    rng = random.Random(11)
    parts = ["".join(rng.choice("abé") for _ in range(rng.randint(20, 70))) for _ in range(12)]
    rows = [(rng.randint(0, 25), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for _ in range(60)]
    got = op2_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(tuple(r)[:5] for r in got.collect()) == brute_repeats(rows)


def test_op2_hot_grams_meet_by_window(spark, monkeypatch):
    monkeypatch.setattr(op2_repeats, "HOT_ENTRIES", 40)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    passage = noise(130)
    common = ["", "", "shared start of the context ", "other"]
    rows = [(rng.randint(0, 900), noise(rng.randint(0, 60)) + rng.choice(common) + passage[rng.choice([0, 0, 0, 7, 40]) : rng.choice([130, 130, 95])] + rng.choice(common) + noise(rng.randint(0, 60))) for _ in range(400)]
    rows += [(5, passage + "\n" + passage), (None, passage), (900, noise(300)), (901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hot = op2_repeats.hot_grams(docs, 60_000)
    assert len(hot)
    got = op2_repeats.remove_repeats(docs)
    high = lambda r: (10**6 if r[0] is None else r[0], *r[1:5])
    assert sorted(high(r) for r in got.collect()) == brute_repeats([high(r) for r in rows])
    # no bucket sees all documents of the passage: its widest task has an entry a document only for windows of its own hash
    sampled = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(op2_repeats._sampler(256, hot), "kind int, bucket int, payload binary")
    width = {op2_repeats._SAMPLE: sum(f[1] for f in op2_repeats._ENTRY), op2_repeats._WINDOW: sum(f[1] for f in op2_repeats._HOT)}
    most = Counter()
    for r in sampled.where(F.col("kind").isin(*width)).collect():
        most[r["kind"], r["bucket"]] += len(r["payload"]) // width[r["kind"]]
    assert max(most.values()) < 200 and any(kind == op2_repeats._WINDOW for kind, _ in most)


PAGES = "page_id long, url string, html string, host string, rule string"
URLS = [
    "https://a.example.org/es/1", "https://b.example.org/en/12?x", "HTTP://WWW.News.Example.ORG/en/2", "http://shop.example.com/de/3", "http://shop.example.com/fr/3#a", "http://shop.example.com/en/3",
    "https://far.example.net/x", "https://far.example.net", "no url", None, "", "://", "x://org/", "https://example.org?/es/", "http://org.evil.net/org/", "http://cheap.net/1", "http://links.net/1",
]


def make_pages():
    links = {15: '<a href="http://shop.example.com/x">', 16: "<A HREF='//A.example.org'>t</a><img src=https://news.example.org/x.png>"}
    return [(k, u, links.get(k, "<a href='/own'>x</a>") if k % 5 else None, "h", "r") for k, u in enumerate(URLS)] + [(3, URLS[3], "", "h", "r")]


def test_op3(spark):
    pages = spark.createDataFrame(make_pages(), PAGES).repartition(3)
    got = op3_urls.filter_urls(pages)
    columns = ["page_id", "host", "path", "rule", "verdict"]
    given = pd.DataFrame(make_pages(), columns=["page_id", "url", "html", "host", "rule"]).astype({"url": "string", "html": "string"})[["page_id", "url", "html"]]
    assert frame(got.select(*columns).toPandas()) == by_sql(op3_urls.SQL, pages=given)
    rows = {r["page_id"]: r for r in got.collect()}
    assert rows[0]["rule"] == "example.org/es/" and rows[1]["verdict"] == "block" and rows[2]["rule"] == "org/" and rows[7]["path"] == "" and rows[8]["host"] == "" and rows[11]["host"] == ""
    assert rows[15]["verdict"] in ("allow", "block") and rows[16]["trust"] is not None
    assert op3_urls.filter_urls(pages.limit(0)).count() == 0


def test_op3_distrust_flows_back(spark):
    block, allow = [("x.com", "/", "block")], [("y.org", "/", "allow")]
    rows = [(1, "http://x.com/1", ""), (2, "http://farm.net/1", '<a href="http://x.com/a">'), (3, "http://fan.net/1", ""), (4, "http://y.org/1", '<a href="http://fan.net/">')]
    got = {r["host"]: r for r in op3_urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), block + allow).collect()}
    assert got["farm.net"]["verdict"] == "block" and got["fan.net"]["verdict"] == "allow" and got["fan.net"]["trust"] > 0


def test_op3_climbs_all_domains(spark):
    long = ".".join(f"a{k}" for k in range(200))  # more labels than a name in DNS has
    rows = [(1, "http://k.l.m.deep.net/1", ""), (2, "http://deep.net/2", ""), (3, f"http://{long}.other.net/", ""), (4, "http://other.net/", ""), (5, "http://a..b.net/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in op3_urls.filter_urls(pages, [("k.l.m.deep.net", "/", "block")]).collect()}
    assert got[2]["verdict"] == "block" and got[2]["distrust"] > 0 and got[4]["distrust"] == 0 and len(got) == 5
    hosts = spark.createDataFrame([("k.l.m.deep.net",), ("a..b.net",), (f"{long}.net",)], "host string")
    edges = {(r["src"], r["dst"]) for r in op3_urls.host_edges(pages.where("false"), hosts).collect()}
    up = {("k.l.m.deep.net", "l.m.deep.net"), ("l.m.deep.net", "m.deep.net"), ("m.deep.net", "deep.net"), (".b.net", "b.net")}
    labels = f"{long}.net".split(".")
    suffix = lambda n: ".".join(labels[-n:])
    up |= {(suffix(201), suffix(127))} | {(suffix(n), suffix(n - 1)) for n in range(127, 2, -1)}
    assert edges == up | {(b, a) for a, b in up}


def test_op3_hubs_are_dealt_over_parts(spark, monkeypatch):
    rows = [(k, f"http://h{k % 60}.net/en/{k}", f"<a href='http://hub.com/de/'>x</a><a href='//h{(k * 7) % 60}.net'>y</a>") for k in range(200)] + [(900, "http://hub.com/de/1", "".join(f"<a href='http://h{k}.net/'>z</a>" for k in range(60)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = frame(op3_urls.filter_urls(pages).drop("trust", "distrust").toPandas())
    monkeypatch.setattr(op3_urls, "HUB_EDGES", 5)
    got = op3_urls.filter_urls(pages)
    assert frame(got.drop("trust", "distrust").toPandas()) == want == by_sql(op3_urls.SQL, pages=pd.DataFrame(rows, columns=["page_id", "url", "html"]))


def check_packing(rows, given):
    tokenizer = op4_packing.ids_of(op4_packing.default_tokenizer()).library
    want = Counter()
    for doc, text in given:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):  # noqa: B905
            want[doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= 1024 for v in at.values())
    return len(at), sum(at.values())


def test_op4(spark, docs, empty):
    rows = op4_packing.pack_documents(docs).collect()
    n, tokens = check_packing(rows, TEXTS)
    assert n <= -(-tokens // 1024) + 2
    assert op4_packing.pack_documents(empty).count() == 0


def test_op5(spark, docs, empty):
    rows = op5_media.digests(docs).collect()
    text = dict(TEXTS)
    for r in rows:
        data = (text[r["doc_id"]] or "").encode()
        payload = data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert op5_media.digests(empty).count() == 0
    stored = op5_media.encode_column(docs.select("doc_id", "text").where("doc_id < 6")).withColumn("media", F.when(F.col("doc_id") != 3, F.col("media")))
    back = {r["doc_id"]: r for r in op5_media.decode_images(stored, "doc_id").collect()}
    assert back[3]["error"] == "no file" and back[5]["width"] == 64
    assert bytes(p >> 8 & 255 for p in back[5]["pixels"]).rstrip(b"\0").decode() == text[5]


def brute_groups(rows, width, percent):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("width", "percent", "small"), [(4, 85, False), (5, 80, True)])
def test_op6(spark, monkeypatch, empty, width, percent, small):
    if small:  # tiles are cut, shingles common, bitmaps folded and pivots hot at this size already
        for module, name, value in ((op6_jaccard, "TILE", 4), (op6_jaccard, "COMMON_ROWS", 5), (op6_jaccard, "COMMON_SEEN", 5), (op6_jaccard, "SHORT", 8), (common, "SPREAD_ROWS", 3)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(5)
    rows = list(TEXTS)
    seed = sentence(rng, ENGLISH, 200).split()
    for k in range(60):  # a chain of near copies, and copies of its ends
        if k % 3:
            seed[rng.randrange(len(seed))] = f"w{k}"
        rows.append((1000 + k, " ".join(seed)))
    shared = sentence(rng, GERMAN, 60)
    rows += [(2000 + k, shared + " " + sentence(rng, [f"{w}{k}" for w in ENGLISH], 8 + 3 * k)) for k in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    if small:
        texts = df.withColumnRenamed("doc_id", "id")
        assert len(op6_jaccard.common_shingles(texts, width)) > 20
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op6_jaccard.near_groups(df, width, percent).collect()}
    assert got == brute_groups(rows, width, percent)
    assert len(rows) == op6_jaccard.near_groups(df, width, percent).count()
    assert op6_jaccard.near_groups(empty).count() == 0


def test_op6_ids_with_two_texts_and_no_id(spark):
    rng = random.Random(6)
    one, two, three = (sentence(rng, ENGLISH, 80) for _ in range(3))
    rows = [(5, one), (5, two), (7, two + " more"), (9, one + " more"), (None, one), (None, three), (None, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in op6_jaccard.near_groups(df).collect())
    assert got == Counter([(5, 5), (5, 5), (7, 5), (9, 5), (None, 5), (None, None), (None, None), (11, 11)])


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5400)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_op7(spark, docs, empty):
    got = op7_language.identify(docs).collect()
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    lang = {r[0]: r[2] for r in ROWS}
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(ROWS) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    assert {found[k]["lang_pred"] for k in (0, 1, 2, 4)} == {"und"}
    clean = [d for d in range(19, 109)]
    assert np.mean([found[d]["lang_pred"] == lang[d] for d in clean if held(d)]) >= 0.95
    assert op7_language.identify(empty).count() == 0
    assert op7_language.identify(docs, carry=True).select("row.*").columns == docs.columns
    assert {r["lang_pred"] for r in op7_language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op7_spans_of_mixed_text(spark, docs):
    model = op7_language.fit(docs)
    rng = random.Random(3)
    tokens = sentence(rng, ENGLISH, 40).split() + sentence(rng, GERMAN, 40).split() + sentence(rng, GREEK, 10).split()
    scores, letters = model.of_tokens(tokens)
    _, _, spans = op7_language.label(model, tokens, scores, letters, op7_language.PENALTY, True)
    assert [s["lang"] for s in spans] == ["en", "de", "el"] and abs(spans[1]["begin"] - 40) <= 4


@pytest.mark.parametrize(("lang", "letters", "end"), [("zh", "的一是不了人我在有他这为之大来以个中上们到说国和地也子时道出", "。"), ("th", "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอฮ", ""), ("ja", "のにはをたがでてとしれさあいうえおかきくけこ日本人大国", "、")])
def test_op7_spans_of_scripts_without_spaces(spark, lang, letters, end):
    rng = random.Random(9)
    unspaced = lambda n: "".join(rng.choice(letters) + (end if k % 20 == 19 else "") for k in range(n))
    rows = [(k, unspaced(200) if k % 2 else sentence(rng, ENGLISH, 60), lang if k % 2 else "en") for k in range(40)]
    mixed = sentence(rng, ENGLISH, 30) + " " + unspaced(500) + " " + sentence(rng, ENGLISH, 30)
    quoted = sentence(rng, ENGLISH, 60) + " " + letters[:2] + " " + sentence(rng, ENGLISH, 60)
    docs = spark.createDataFrame([*rows, (100, mixed, None), (101, quoted, None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in op7_language.identify(docs).where("doc_id >= 100").collect()}
    assert found[100]["lang_pred"] == lang and found[101]["lang_pred"] == "en" and found[101]["score"] > 0.9
    for k, text, chars in ((100, mixed, 500), (101, quoted, 2)):
        words = op7_language.split_words(text)
        assert "".join(words) == "".join(text.split())
        assert [x["lang"] for x in found[k]["spans"]] == ["en", lang, "en"]
        span = found[k]["spans"][1]
        inner = "".join(words[span["begin"] : span["end"]])
        assert abs(sum(c in letters for c in inner) - chars) == 0 and not any(c.isascii() for c in inner)


def test_op8(spark, docs, empty):
    library = op8_pieces.codec(op8_pieces.default_model()).library
    text = dict(TEXTS)
    for r in op8_pieces.encode(docs).collect():
        ids = library.encode(text[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == library.decode(ids) and r["agrees"] and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert op8_pieces.encode(empty).count() == 0


TURNS = "conv_id long, turn long, role string, text string, formatted string, segments int"
TALKS = [
    (1, 1, "assistant", "yes"), (1, 0, "user", "well?"), (1, 2, "assistant", "more\n"), (2, 0, "system", None), (2, 1, "assistant", ""), (2, None, "user", "first"), (3, 0, None, "<turn/>"), (3, 1, "a:\nb#", "</turn>\n### x:\n"),
    (4, 0, "assistant", r"\\l \b <h> ### \\"), (4, 0, "assistant", r"\\l \b <h> ### \\"), (4, 0, "user", "tie"), (None, 0, "user", "no id"), (5, 700, "user", "late"), (5, 3, "user", "soon"), *[(6, k, "user" if k % 2 else "assistant", f"t{k} 日") for k in range(1200)],
]


def test_op9(spark):
    turns = spark.createDataFrame([(*t, "f", 1) for t in TALKS], TURNS).repartition(3)
    out = op9_chat.format_conversations(turns)
    read = {r["conv_id"]: [(t["role"], t["text"]) for t in r["ts"]] for r in out.select("conv_id", op9_chat.read_turns(F.col("formatted")).alias("ts")).collect()}
    want = {}
    order = lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")
    for c, _, role, text in sorted(TALKS, key=order):
        want.setdefault(c, []).append((role or "", text or ""))
    assert read == want
    shown = {r["conv_id"]: r["formatted"] for r in out.collect()}
    assert shown[1] == "### user:\nwell?</turn>\n### assistant:\nyes<turn/>more\n</turn>\n"
    assert op9_chat.format_conversations(turns.limit(0)).count() == 0


def test_op9_query_matches_sql(spark, tmp_path):
    talks = [t for t in TALKS if t[0] is not None]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    given = pd.DataFrame(talks, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64", "role": "string", "text": "string"})
    assert frame(op9_chat.op9_chat_format(spark, str(tmp_path)).toPandas()) == by_sql(op9_chat.SQL, conversations=given)


def test_op10(spark):
    rows = [(k, f"u{k}", h, "text", 1) for k, h in enumerate([None, "", "<article><p>One.<p>Two &amp; three.</article><footer>f</footer>", "<p>" * 500 + "deep", "<article>" + "<p>Long text.</p>" * 3000 + "</article>"])]
    df = spark.createDataFrame(rows + rows[2:3], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in op10_html.extract(df).collect()}
    assert got[0] == got[1] == ("", 0) and got[2] == ("One.\nTwo & three.", 17) and got[4][0].count("\n") == 2999
    assert op10_html.extract(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def stages(spark, docs):
    out, given = [], docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, given, "nowhere").cache()
        out.append((name, given, made))
        given = made
    return out


def test_pipeline_stages(spark, stages):
    (_, given, spoken), (_, _, good), (_, _, single), (_, _, cut), (_, _, packed) = stages
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    text = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    for df in (spoken, good, single, cut):
        assert df.columns == corpus_pipeline.COLUMNS
    assert not ids(spoken) & {0, 1, 2, 4} and set(range(20, 100)) <= ids(spoken)
    verdict = {r["doc_id"]: r["kept"] for r in op1_quality.judge(spoken).collect()}
    assert ids(good) == {d for d, kept in verdict.items() if kept} and set(range(19, 109)) <= ids(good)
    groups = brute_groups(text(good), 5, 80)
    assert sorted(d for d, _ in text(single)) == sorted(d for d, (_, root) in groups.items() if d == root)
    brute = {d: (n, gone, sha) for d, n, gone, _, sha in brute_repeats(text(single))}
    kept = text(cut)
    assert {d for d, _ in kept} == {d for d, (n, gone, _) in brute.items() if gone < n}
    assert all(hashlib.sha256(t.encode()).hexdigest() == brute[d][2] for d, t in kept if t.isascii())
    check_packing(packed.collect(), kept)


def test_near_copies_keep_one_fixed_row_of_an_id(spark):
    rng = random.Random(9)
    one, two, other = (sentence(rng, ENGLISH, 60) for _ in range(3))
    low, high = sorted((one, two))
    rows = [(1, high), (1, low), (2, low + " and more"), (3, high + " and more"), (4, other), (4, other), (None, low), (None, None), (6, None)]
    full = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for df in (full.repartition(3), full.orderBy(F.rand(3))):
        got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, df, "nowhere").collect())
        assert got == Counter([(1, low), (4, other), (None, low), (None, None), (6, None)])


def test_pipeline_run(spark, docs, tmp_path):
    docs.select(*corpus_pipeline.COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    empty = tmp_path / "none"
    docs.select(*corpus_pipeline.COLUMNS).limit(0).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0


def test_registry():
    assert sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES) == list(range(1, 14)) and set(registry.ORACLES) <= set(registry.QUERIES)
    assert json.dumps(sorted(registry.ORACLES))
