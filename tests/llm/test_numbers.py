"""Kernels without Spark: hashes, merges, packing plans, cuts, images, spans."""

import base64
import random
import time
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import arrays, op2_repeats, op4_packing, op5_media, op7_language, op8_pieces, op10_html, webp
from waymark.llm.memo import Memo

ODD = ["", " ", "  ", "a", " a", "a ", "a  b   c", "\n\n x\t y ", "naïve 日本語 テスト 🎉🎉", "▁x ▁▁ y", "<s> </s> <0x0A> <|endoftext|>", "it's we'll  DON'T 123 4.5%", "a\xa0b  c", "x" * 500, "\0 a", "a \n b", "  \n  lead", "é" * 50 + " " * 7, "日" * 3000]


def odd_texts(n=1500):
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("ab \n\t▁é日.1'sThe,") for _ in range(rng.randint(0, 40))) for _ in range(n)]


def brute_shingles(text, width):
    w = (text or "").encode().lower().split()
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_shingle_sets_are_those_of_words():
    texts = [*odd_texts(300), None, "A b C d", "a B c D", "a b c d e a b c d"]
    for width in (4, 5):
        hashed = arrays.shingle_sets(pa.array(texts), width)
        brute = [brute_shingles(t, width) for t in texts]
        assert [len(h) for h in hashed] == [len(b) for b in brute]
        for i, j in random.Random(2).sample(list(product(range(len(texts)), repeat=2)), 3000):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(brute[i] & brute[j])


def test_pieces_cover_the_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 100, 3, 3)] + [None]})
    parts = list(arrays.pieces(batch, "text", 10))
    assert sum(p.num_rows for p in parts) == 6 and max(p.num_rows for p in parts) >= 2


def test_sentence_pieces_match_the_library():
    c = op8_pieces.codec(op8_pieces.default_model())
    for t in odd_texts():
        ids = c.library.encode(t)
        n, joined, text = c.encode(t)
        assert (n, joined, text) == (len(ids), ",".join(map(str, ids)), c.library.decode(ids)), repr(t)
    assert c.agreed()


def test_token_ids_match_the_library():
    e = op4_packing.ids_of(op4_packing.default_tokenizer())
    for t in odd_texts():
        assert np.frombuffer(e.of(t), np.uint32).tolist() == e.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_memo_is_bounded():
    calls = []
    m = Memo(lambda k: calls.append(k) or k * 2, limit=3, longest=2)
    assert [m[k] for k in "abcabcdabc"] == [k * 2 for k in "abcabcdabc"] and len(m) <= 3 and len(m.old) <= 3
    assert m["long"] == "longlong" and "long" not in m


@pytest.mark.parametrize("lengths", [[], [1024], [1], [600] * 7, [512] * 9, [700, 324] * 20 + [500, 300, 224] * 10, list(range(1, 1024))])
def test_plan_uses_every_piece_once(lengths):
    h = np.bincount(lengths, minlength=1025) if lengths else np.zeros(1025, np.int64)
    plan = op4_packing.plan(h)
    used = Counter()
    for shape, n in plan:
        assert sum(shape) <= 1024 and n > 0
        for x in shape:
            used[x] += n
    assert used == Counter(lengths)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(5)
    lengths = np.clip(rng.lognormal(5.8, 0.9, 60_000), 1, 1024).astype(int)
    n = sum(k for _, k in op4_packing.plan(np.bincount(lengths, minlength=1025)))
    assert n <= 1.01 * -(-lengths.sum() // 1024) or n <= 1.01 * (lengths > 512).sum()


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 8)
        own = [rng.randint(-9, 9) for _ in range(n)]
        edges = {(a, b): rng.randint(1, 9) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda s: sum(max(w, 0) if not x else max(-w, 0) for w, x in zip(own, s)) + sum(w for (a, b), w in edges.items() if s[a] != s[b])  # noqa: B023, B905, E731
        assert cost(op10_html.min_cut(own, edges)) == min(map(cost, product([False, True], repeat=n)))


PAGES = [
    (None, ""), ("", ""), ("plain words only, long enough to be a text of its own, as it stands here in full.", "plain words only, long enough to be a text of its own, as it stands here in full."),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head&amp;line</h1><p>One  two<b> three</b><br>four.<p>Five &lt;six&gt;</article><footer>&copy; x</footer>", "Head&line\nOne two three four.\nFive <six>"),
    ("<article><p>Text.</p><div class='comments'><p>nice post</p></div><aside>side</aside><form>Name <input></form></article>", "Text."),
    ('<script>var t="</p>";</script><article>a<!-- <p>no</p> -->b</article>', "ab"),
    ("<header>Site</header><article><header><h1>Title</h1></header><p>Body.</p></article><div class=\"ad\">Buy</div><div id='cookie-notice'>We use</div>", "Title\nBody."),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
    ("<article><p>never closed <b>bold", "never closed bold"), ("<<<>>><", ""), ("<main>1 < 2 &amp; 3<p>x</main", "1 < 2 & 3\nx</main"), ("<main>&#x41;&#0066;&#99999999999;</main>", "AB\ufffd"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert op10_html.main_text(page) == text


ARTICLE = "<article><h1>Head</h1><p>A first paragraph of the article.</p><p>A second one, and its end.</p></article>"
TEXT = "Head\nA first paragraph of the article.\nA second one, and its end."


@pytest.mark.parametrize("wrapper", ['class="overflow-hidden"', 'aria-hidden="false"', 'class="has-sidebar"', 'class="content-sidebar-wrap"', 'data-x="hidden"', 'class="sidebar"', 'data-role="search"', 'style="x-display:none-y"'])
def test_wrappers_keep_their_article(wrapper):
    page = f"<body><div {wrapper}>{ARTICLE}</div><footer>f</footer></body>"
    assert op10_html.main_text(page) == TEXT
    main = page.replace("article>", "main>")
    assert op10_html.main_text(main) == TEXT


KEPT = ["overflow-hidden", "share-prices", "comments-policy", "social-policy", "entry-header", "search-engines", "nav-tabs-content", "has-sidebar", "related-work"]


@pytest.mark.parametrize("name", KEPT)
def test_names_that_only_sound_like_boilerplate_keep_their_text(name):
    part = "<p>A paragraph of some length stands here, so that it reads like a text and not like a label.</p>"
    text = part[3:-4]
    for attribute in (f'class="{name}"', f'id="{name}"', f'data-state="hidden" class="{name}"'):
        assert op10_html.main_text(f"<body><article><p>First one.</p><div {attribute}>{part}</div></article></body>") == "First one.\n" + text
        assert op10_html.main_text(f"<body><div {attribute}>{part}{part}</div></body>") == text + "\n" + text


def test_hidden_inline_parts_are_left_out():
    page = "<article><p>vis<span hidden>se<span>cr</span>et</span>ible <b style='display:none'>x<p>Next one.</p><i aria-hidden=true>y</i>z</article>"
    assert op10_html.main_text(page) == "visible\nNext one.\nz"


def _whole_page_cost(found, own, edges, labels):
    return sum(abs(w) for w, x in zip(own, labels, strict=True) if (w > 0) != x) + sum(w for (a, b), w in edges.items() if labels[a] != labels[b])


def test_the_cut_decides_whole_pages():
    long = "<p>A paragraph that is long enough to count as the text of an article, as far as its length can tell, and then goes on.</p>"
    link = '<p><a href="/x">A linked title</a></p>'
    linked = f"<article>{long}{link}{long}</article>"
    found = op10_html.blocks(linked)
    assert [op10_html.score(b) > 0 for b in found] == [True, False, True]
    assert op10_html.main_text(linked).count("\n") == 2  # the cut keeps what its score alone would drop
    assert op10_html.main_text(f"<article>{long}{link * 12}</article>").count("\n") == 0
    rng = random.Random(8)
    for _ in range(120):
        parts = [rng.choice([long, link, "<p>ab</p>", "<li>cd.</li>", "<h2>Head</h2>", "<div class=share-prices>x y z</div>", "<nav>n</nav>", "<div><p>inner text.</p></div>"]) for _ in range(rng.randint(1, 9))]
        page = rng.choice(["<article>%s</article>", "<main>%s</main>", "<body>%s</body>", "<div class='content'>%s</div>"]) % "".join(parts)
        found = op10_html.blocks(page)
        own, edges = [op10_html.score(b, any(b.flags & 6 for b in found)) for b in found], op10_html.smoothness(found)
        best = min(_whole_page_cost(found, own, edges, s) for s in product([False, True], repeat=len(found)))
        assert _whole_page_cost(found, own, edges, op10_html.min_cut(own, edges)) == best


LONG = ["<a " * 350_000, "<a " * 350_000 + ">", '<p x="1" ' * 120_000, "<p x='" * 150_000 + ">", "<a '\"" * 150_000 + ">", "<div>" * 100_000 + "</x>" * 100_000, "<!--" * 250_000, "<p>&#" + "9" * 1_000_000 + ";", "<p a" + " " * 500_000 + "</script" + " " * 500_000]


@pytest.mark.parametrize("page", LONG, ids=range(len(LONG)))
def test_long_broken_pages_take_linear_time(page):
    began = time.process_time()
    op10_html.main_text(page)
    assert time.process_time() - began < 5  # quadratic time would be hours


@pytest.mark.parametrize("part", ["hidden", "HIDDEN=''", "aria-hidden=true", "style='color:red; Display : none'", "class='x ad'", "id=site-footer", "class='cookie-banner'", "class='sidebar-inner'", "role=search", "class=post-comments"])
def test_hidden_and_boilerplate_parts_are_left_out(part):
    assert op10_html.main_text(f"<body><main>{ARTICLE}<div {part}><p>Not a part of the text.</p></div></main></body>") == TEXT
    assert op10_html.main_text(f"<body>{ARTICLE}<div class=comments><article class=comment><p>A remark of a reader.</p></article></div></body>") == TEXT


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    for _ in range(60):
        s = rng.normal(0, 3, (6, 3)).astype(np.float32)
        path = op7_language.viterbi(s, 2.0)
        value = lambda p: sum(float(s[t, k]) for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, B905, E731
        assert value(path.tolist()) == pytest.approx(max(map(value, product(range(3), repeat=6))), abs=1e-4)


def test_viterbi_leaves_out_the_lead_where_two_others_fit_better():
    assert op7_language.viterbi(np.array([[8, -9, 0], [-9, 8, 0]], np.float32), 10.0).tolist() == [0, 1]
    rng = np.random.default_rng(8)
    unused = 0
    for _ in range(60):
        s = np.zeros((6, 3), np.float32)
        s[:3, 0], s[3:, 0] = rng.uniform(1, 3, 3), rng.uniform(-5, -3, 3)
        s[:3, 1], s[3:, 1] = rng.uniform(-5, -3, 3), rng.uniform(1, 3, 3)
        path = op7_language.viterbi(s, 10.0).tolist()
        value = lambda p: sum(float(s[t, k]) for t, k in enumerate(p)) - 10.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, B905, E731
        assert value(path) == pytest.approx(max(map(value, product(range(3), repeat=6))), abs=1e-4)
        unused += 2 not in path
    assert 0 < unused


def test_sampling_sees_every_match():
    """Two texts sharing a window sample the same gram in it, at the same place."""
    rng = random.Random(3)
    for _ in range(100):
        shared = bytes(rng.choice(b"abc") for _ in range(50))
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) + shared + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) for _ in range(2)]
        found = []
        for t in texts:
            buf, at = np.frombuffer(t, np.uint8), np.array([0, len(t)])
            pos, gram, _ = op2_repeats.sample(buf, at, arrays.rolling(buf))
            begin = t.index(shared)
            found.append({(int(p) - begin, int(g)) for p, g in zip(pos, gram, strict=True) if 0 <= p - begin <= op2_repeats.REACH})
        assert found[0] & found[1]


# Lossless WebP: a small writer of every feature, for the decoder.


def one_pixel():
    return base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")


def test_known_file():
    assert webp.decode(one_pixel()).tolist() == [[0]]


def test_samples_round_trip():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"a" * 64, b"ab" * 50, bytes(range(256)) * 3, "é日".encode() * 40, rng.bytes(5000), b"\0" * 63 + b"x", b"The " * 2000):
        payload = op5_media._payload(data)
        assert op5_media.from_image(op5_media.to_image(payload), len(payload))[1] == payload and len(payload) % 64 == 0


def fibonacci_counts(n):
    a, b, out = 1, 1, []
    for _ in range(n):
        out.append(a)
        a, b = b, a + b
    return np.array(out)


def test_repeats_become_back_references():
    rng = np.random.default_rng(11)
    line = b"This line stands here again and again.\n"
    for data in (line * 40, b"x" + bytes(rng.integers(97, 123, 500).astype(np.uint8)) + b" " + line * 3 + bytes(rng.integers(97, 123, 300).astype(np.uint8)) + b"\n" + line * 130, b"ab " * 5000, (b"word " * 7 + b"end\n") * 60 + b"tail"):
        payload = np.frombuffer(data + b"\0" * (-len(data) % 64), np.uint8)
        assert webp.find_repeats(payload)
        file = webp.encode_samples(payload.reshape(-1, 64))
        assert len(file) < len(payload) / 3
        assert ((webp.decode(file) >> 8) & 255).astype(np.uint8).tobytes() == payload.tobytes()
        with pytest.raises(webp.WebPError):
            webp.decode(file[: len(file) // 2])
    v = np.arange(1, 1 << 20, 37)
    prefix, extra, rest = webp.number_prefix(v)
    assert (np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + rest) + 1 == v).all() and (extra == np.where(prefix < 4, 0, (prefix - 2) >> 1)).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16])
def test_few_colours_become_a_palette(colours):
    rng = np.random.default_rng(colours)
    samples = rng.integers(0, colours, (50, 65)).astype(np.uint8) * 13 + 7
    out = webp.Writer()
    webp.put_palette(out, np.unique(samples))
    file = webp.encode_samples(samples)
    assert ((webp.decode(file) >> 8) & 255 == samples).all()
    if colours > 2:
        assert len(file) < samples.size  # several to a pixel


def test_code_lengths_fit():
    for limit, counts in ((15, fibonacci_counts(40)), (7, fibonacci_counts(19)), (15, np.ones(256, np.int64))):
        lengths = webp.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -int(n) for n in lengths) == 1


class Image:
    """Writes an entropy-coded image from operations: a pixel, ("copy", length, distance code) or ("cache", index)."""

    def __init__(self, out, cache_bits=0):
        self.out, self.cache_bits = out, cache_bits

    @staticmethod
    def number(value):
        if value <= 4:
            return value - 1, 0, 0
        v = value - 1
        n = v.bit_length() - 1
        half = (v >> (n - 1)) & 1
        return 2 * n + half, v - ((2 + half) << (n - 1)), n - 1

    def write(self, operations, top=False, groups=1, of=None, meta=None):
        out = self.out
        out.put(int(self.cache_bits > 0), 1)
        if self.cache_bits:
            out.put(self.cache_bits, 4)
        if top:
            out.put(int(meta is not None), 1)
            if meta is not None:
                bits, pixels = meta
                out.put(bits - 2, 3)
                Image(out).write(pixels)
        sizes = (280 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40)
        counts = [[np.zeros(s, np.int64) for s in sizes] for _ in range(groups)]
        symbols = []
        for k, op in enumerate(operations):
            g = of[k] if of else 0
            if isinstance(op, tuple) and op[0] == "copy":
                (a, ax, an), (b, bx, bn) = self.number(op[1]), self.number(op[2])
                row = [(0, 256 + a, ax, an), (4, b, bx, bn)]
            elif isinstance(op, tuple):
                row = [(0, 280 + op[1], 0, 0)]
            else:
                row = [(0, op >> 8 & 255, 0, 0), (1, op >> 16 & 255, 0, 0), (2, op & 255, 0, 0), (3, op >> 24, 0, 0)]
            symbols.append((g, row))
            for c, s, _, _ in row:
                counts[g][c][s] += 1
        lengths = [[webp.code_lengths(c) for c in group] for group in counts]
        for group in lengths:
            for x in group:
                out.put_prefix(x if x.any() else np.eye(1, len(x), 0, dtype=np.int64)[0])
        codes = [[webp.canonical(x) for x in group] for group in lengths]
        for g, row in symbols:
            for c, s, extra, n in row:
                if np.count_nonzero(lengths[g][c]) > 1:
                    out.put(int(codes[g][c][s]), int(lengths[g][c][s]))
                out.put(extra, n)


def file_of(width, height, write, alpha=True):
    out = webp.Writer()
    webp.put_head(out, width, height, alpha)
    write(out)
    return webp.wrap(out.to_bytes())


def random_pixels(h, w, seed=0, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)[rng.integers(0, colours, (h, w))]
    return rng.integers(0, 1 << 32, (h, w), dtype=np.uint64).astype(np.uint32)


def no_transform(out):
    out.put(0, 1)


def test_literals_back_references_and_cache():
    p = [0xFF102030, 0x80405060, 0x01020304, 0xFFFFFFFF]
    index = lambda x: (x * webp.CACHE_FACTOR & 0xFFFFFFFF) >> 29
    operations = [*p, ("copy", 4, 124), ("cache", index(p[3])), ("copy", 3, 2), ("copy", 4, 1)]
    # distance code 124 is 4 pixels back; code 2 is the pixel to the left; code 1 the one above
    got = webp.decode(file_of(4, 4, lambda o: (no_transform(o), Image(o, 3).write(operations, top=True)))).ravel().tolist()
    assert got == [*p, *p, *[p[3]] * 4, *[p[3]] * 4]


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)


def test_groups_of_codes():
    pixels = random_pixels(8, 8, 1)
    blocks = [0, 1, 1, 0]
    of = [blocks[(y >> 2) * 2 + (x >> 2)] for y in range(8) for x in range(8)]
    meta = (2, [0xFF000000 | b << 8 for b in blocks])
    got = webp.decode(file_of(8, 8, lambda o: (no_transform(o), Image(o).write([int(v) for v in pixels.ravel()], top=True, groups=2, of=of, meta=meta))))
    assert (got == pixels).all()


def spec_predict(mode, left, above, corner, right):
    """The predictors on packed pixels, written channel by channel."""
    ch = lambda p: [p >> s & 255 for s in (0, 8, 16, 24)]
    L, T, TL, TR = map(ch, (left, above, corner, right))
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: max(0, min(255, v))
    if mode == 11:
        estimate = [a + b - c for a, b, c in zip(L, T, TL, strict=True)]
        pl, pt = (sum(abs(e - x) for e, x in zip(estimate, v, strict=True)) for v in (L, T))
        out = L if pl < pt else T
    elif mode == 12:
        out = [clamp(a + b - c) for a, b, c in zip(L, T, TL, strict=True)]
    elif mode == 13:
        out = [clamp(a + int((a - c) / 2)) for a, c in zip(avg(L, T), TL, strict=True)]
    else:
        out = [[0, 0, 0, 255], L, T, TR, TL, avg(avg(L, TR), T), avg(L, TL), avg(L, T), avg(TL, T), avg(T, TR), avg(avg(L, TL), avg(T, TR))][mode]
    return sum(v << s for v, s in zip(out, (0, 8, 16, 24), strict=True))


def minus(a, b):
    return sum(((a >> s) - (b >> s) & 255) << s for s in (0, 8, 16, 24))


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    h, w = 5, 7
    pixels = random_pixels(h, w, mode).astype(object)
    rest = []
    for y in range(h):
        for x in range(w):
            at = lambda yy, xx: int(pixels[yy, xx])  # noqa: B023, E731
            if y == 0:
                guess = 0xFF000000 if x == 0 else at(0, x - 1)
            elif x == 0:
                guess = at(y - 1, 0)
            else:
                guess = spec_predict(mode, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), at(y - 1, x + 1) if x + 1 < w else at(y, 0))
            rest.append(minus(int(pixels[y, x]), guess))

    def write(o):
        o.put(1, 1)
        o.put(webp.PREDICTOR, 2)
        o.put(0, 3)
        Image(o).write([0xFF000000 | mode << 8] * 4)
        no_transform(o)
        Image(o).write(rest, top=True)

    assert (webp.decode(file_of(w, h, write)).astype(object) == pixels).all()


def test_cross_colour_and_green():
    h, w = 4, 4
    pixels = random_pixels(h, w, 9)
    factors = (0xF3, 0x25, 0x81)  # green to red, green to blue, red to blue
    signed = lambda v: v - 256 if v > 127 else v
    rest = []
    for v in pixels.ravel().tolist():
        blue, green, red, alpha = v & 255, v >> 8 & 255, v >> 16 & 255, v >> 24
        less_red = red - (signed(factors[0]) * signed(green) >> 5) & 255
        less_blue = blue - (signed(factors[1]) * signed(green) >> 5) - (signed(factors[2]) * signed(red) >> 5) & 255
        rest.append(alpha << 24 | (less_red - green & 255) << 16 | green << 8 | (less_blue - green & 255))

    def write(o):
        o.put(1, 1)
        o.put(webp.CROSS_COLOUR, 2)
        o.put(0, 3)
        Image(o).write([0xFF << 24 | factors[2] << 16 | factors[1] << 8 | factors[0]])
        o.put(1, 1)
        o.put(webp.SUBTRACT_GREEN, 2)
        no_transform(o)
        Image(o).write(rest, top=True)

    assert (webp.decode(file_of(w, h, write)) == pixels).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palettes(colours):
    h, w = 6, 11
    palette = random_pixels(1, colours, 3).ravel()
    index = np.random.default_rng(1).integers(0, colours, (h, w))
    share = webp.palette_bits(colours)
    each = 8 >> share
    packed = []
    for y in range(h):
        for x in range(0, w, 1 << share):
            v = sum(int(i) << each * k for k, i in enumerate(index[y, x : x + (1 << share)]))
            packed.append(0xFF000000 | v << 8)
    steps = [int(palette[0]), *[minus(int(b), int(a)) for a, b in zip(palette, palette[1:])]]  # noqa: B905

    def write(o):
        o.put(1, 1)
        o.put(webp.PALETTE, 2)
        o.put(colours - 1, 8)
        Image(o).write(steps)
        no_transform(o)
        Image(o).write(packed, top=True)

    assert (webp.decode(file_of(w, h, write)) == palette[index]).all()


def test_broken_files():
    good = op5_media.to_image(b"abc" * 100 + b"\0" * 20)
    for bad in (b"", b"RIFF", good[:20], good[:40], b"x" + good[1:], good[:30] + b"\xff" * 30):
        with pytest.raises(webp.WebPError):
            webp.decode(bad)
