"""Operator 10, main text of web pages by minimum-cut labelling.

A page becomes blocks of text with their place in the element tree.  A logistic
classifier's log-odds of each block, in hundredths, are its capacity towards
"content" or "boilerplate"; smoothness edges join blocks that follow each other,
the stronger the nearer they are in the tree, and blocks that follow each other
under the same parent; between blocks of different marks they are weak.  The
minimum cut, found by max-flow (Dinic), labels all blocks.

The classifier has text features (length, end of a sentence, heading, share of
links), names of classes and ids (words of a seed list, and hashed), and marks
(elements and roles).  Weights of text and hashed names are fitted to the blocks
of a bounded sample of pages (``SAMPLE_PAGES``) whose elements say what they are:
article and main against nav, header, footer, aside and form.  The fit starts
from the weights given here, which count as much as ``PRIOR_BLOCKS`` blocks, so
few or odd pages change little.

Pages are read in linear time: a tag ends at the next ``>`` outside a quoted
value, and quotes that don't close are plain characters.

Defined results: a null or empty page, and one without content, has an empty
text; broken markup is read as far as it goes, unclosed elements end with their
parent, a ``<`` without a ``>`` behind it is text; pages are treated one by one,
so ties and repeated rows don't matter; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import pieces
from .common import table
from .worker import tidy

_OPEN = re.compile(r"(/?)([a-z][^\s/>]*+)", re.I)
#: The rest of a tag: a quote counts after = only, and only if it closes.
_INSIDE = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+>""")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "iframe", "title", "textarea")}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_PARAGRAPH = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ASIDE = frozenset("nav footer aside menu dialog select button".split())
#: Elements that are asides unless they hold most of the page's sentences, as a form around the whole page does.
_FORMS = frozenset("form fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*+display\s*+:\s*+none\b", re.I)
_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{8,});?")
_ZEROS = re.compile(r"(&#[xX]?)0++(?=[0-9a-fA-F])")

#: Words of class names and ids that speak for boilerplate, words of layout that say nothing, words that turn the meaning, and words of content.
_SEEDS = frozenset(
    "ad ads advert adverts advertisement advertisements banner promo promos promotion sponsor sponsored sponsors cookie cookies consent notice notices nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar footer masthead share sharing social related recommend recommended recommendations comment comments reply replies disqus subscribe newsletter popup modal login signup search".split()
)
_LAYOUT = frozenset("site page global main top bottom left right primary secondary mobile widget widgets post posts entry article articles wrap wrapper container inner outer area section block box bar list item items link links button buttons icon icons form unit slot".split())
_TURNS = frozenset("has no not with without is".split())
_CONTENT = frozenset("article content post entry story body main".split())
_WORDS = re.compile(r"[a-z]+|[0-9]+")

#: Log-odds in hundredths; positive means content.  The text weights are where the fit starts.
BIAS, UNMARKED, IN_ARTICLE, IN_MAIN, IN_ASIDE, IN_HEADER, NAMED = -150, -30, 250, 150, -400, -300, -500
LENGTH, SENTENCE, HEADING, LINKS = 100, 50, 50, -400  # a hundred letters, the end of a sentence, h1 to h3, all letters in links
FULL = 200  # letters from which length says no more
#: Smoothness: neighbours under one parent, under one grandparent, other neighbours, and the next block of the same parent.
SAME_PARENT, SAME_GRANDPARENT, NEXT, SIBLING = 250, 100, 30, 150
#: The part of an edge that is left between blocks of different marks.
OTHER_MARKS = 0.2
SAMPLE_PAGES, PRIOR_BLOCKS, NAME_BUCKETS, FIT_ROWS = 2000, 200, 256, 10_000
_HIDE, _ARTICLE, _MAIN, _ASIDES, _HEADER = 1, 2, 4, 8, 16
#: Letters from which a block counts as sentences that a form is held to wrap, rather than to ask for something.
LONG = 100
_TEXT_FEATURES = 5


class Block(NamedTuple):
    text: str
    flags: int
    parent: int
    grandparent: int
    tag: str
    links: float
    named: int
    names: tuple[int, ...]
    forms: tuple[int, ...] = ()  # numbers of the forms around it, negative for those within an article


class Model(NamedTuple):
    """Fitted shifts of the text weights (bias, length, sentence, heading, links), and weights of hashed names."""

    text: tuple[int, ...] = (0,) * _TEXT_FEATURES
    names: tuple[int, ...] = (0,) * NAME_BUCKETS


def _values(attributes: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), _decoded(double or single or bare))
    return found


def _decoded(text: str) -> str:
    """Character references replaced; numbers beyond all code points stand for an unknown character."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _NUMBER.sub("\ufffd", _ZEROS.sub(r"\1", text))
    return html.unescape(text)


def _hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or bool(_NOT_SHOWN.search(given.get("style", "")))


def name_score(name: str) -> int:
    """Of one class name or id: full if all its words are seeds (but for layout), little if other words qualify them."""
    words = _WORDS.findall(name.lower())
    if not _TURNS.isdisjoint(words):
        return 0
    seeds = sum(w in _SEEDS for w in words)
    if not seeds:
        return 0
    others = sum(w not in _SEEDS and w not in _LAYOUT and not w.isdigit() for w in words)
    return int(NAMED * (seeds / (seeds + others)) ** 3)


def _marks(tag: str, given: dict[str, str], above: tuple) -> tuple[int, int, tuple[int, ...]]:
    """Flags, score of names and hashed names of an element under ``above``."""
    flags, named, hashed = above[1], above[3], above[4]
    if tag == "head":
        return flags | _HIDE, named, hashed
    if tag == "article":
        flags |= _ARTICLE
    elif tag == "main":
        flags |= _MAIN
    elif tag in _ASIDE:
        flags |= _ASIDES
    elif tag == "header" and not above[1] & _ARTICLE:
        flags |= _HEADER
    if tag in ("article", "main"):
        named, hashed = 0, ()  # the element says more than the class of a wrapper
    if given:
        if not _ROLES.isdisjoint(given.get("role", "").lower().split()):
            flags |= _ASIDES
        if _hidden(given):
            flags |= _HIDE
        names = f"{given.get('class', '')} {given.get('id', '')}".split()
        if names and tag not in ("body", "html", "main"):
            named = min(named, *map(name_score, names))
            hashed = tuple({zlib.crc32(n.lower().encode("utf-8", "replace")) % NAME_BUCKETS for n in names})
            if tag != "article" and not named and any(not _CONTENT.isdisjoint(_WORDS.findall(n.lower())) for n in names):
                flags |= _MAIN
    return flags, named, hashed


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple] = [("", 0, 0, 0, (), ())]  # tag, flags, number of the element, score and hashes of names, forms around it
    open_tags: Counter = Counter()
    parts: list[str] = []
    linked, in_link, number = 0, False, 0
    unseen, unseen_depth = "", 0  # a hidden inline element and how often its tag is open within

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_decoded("".join(parts)).split())
            top = stack[-1]
            if text and not top[1] & _HIDE:
                up = [stack[-k][2] if len(stack) >= k else -1 for k in (2, 3)]
                out.append(Block(text, top[1], *up, top[0], min(linked / len(text), 1.0), top[3], top[4], top[5]))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if not unseen:
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def drop(k: int) -> None:
        for gone in stack[k:]:
            open_tags[gone[0]] -= 1
        del stack[k:]

    at, last = 0, page.rfind(">")
    while at < len(page):
        begin = page.find("<", at, last + 1)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            at = page.find(">", begin) + 1
            continue
        opened = _OPEN.match(page, begin + 1)
        if not opened:
            add("<")
            at = begin + 1
            continue
        inside = _INSIDE.match(page, opened.end())
        at = inside.end() if inside else page.find(">", opened.end()) + 1
        attributes = page[opened.end() : at - 1]
        closing, tag = opened[1], opened[2].lower()
        if tag in _RAW and not closing:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = not closing
            if unseen:
                if tag == unseen:
                    unseen_depth += -1 if closing else 1
                    if not unseen_depth:
                        unseen = ""
            elif attributes and not closing and tag not in _VOID and _hidden(_values(attributes)):
                unseen, unseen_depth = tag, 1
            continue
        if tag == "br":
            add(" ")
            continue
        flush()
        in_link, unseen = False, ""
        if closing:
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                drop(k)
            continue
        if tag in _VOID:
            continue
        if tag == "body":
            drop(1)
        if tag in _ENDS_PARAGRAPH and stack[-1][0] == "p":
            drop(len(stack) - 1)
        own = _ENDS_OWN.get(tag)
        while own and len(stack) > 1 and stack[-1][0] in own | {"p"}:
            drop(len(stack) - 1)
        number += 1
        given = _values(attributes) if attributes and not attributes.isspace() else {}
        flags, named, hashed = _marks(tag, given, stack[-1])
        stack.append((tag, flags, number, named, hashed, (*stack[-1][5], -number if flags & _ARTICLE else number) if tag in _FORMS else stack[-1][5]))
        open_tags[tag] += 1
    flush()
    return _forms_judged(out)


def _forms_judged(found: list[Block]) -> list[Block]:
    """Blocks with the mark of an aside where a form around them isn't one that wraps the page's article.

    A form wraps it if it has an article element within, or more than half of the
    page's letters in long blocks (of at least ``LONG`` letters, at most half of
    them in links, in no aside).
    """
    if not any(b.forms for b in found):
        return found
    inside: Counter = Counter()
    wraps, total = set(), 0
    for b in found:
        if b.flags & _ARTICLE:
            wraps.update(form for form in b.forms if form > 0)
        if len(b.text) >= LONG and b.links <= 0.5 and not b.flags & _ASIDES:
            total += len(b.text)
            for form in b.forms:
                inside[form] += len(b.text)
    return [b._replace(flags=b.flags | _ASIDES) if any(form not in wraps and 2 * inside[form] <= total for form in b.forms) else b for b in found]


def text_features(b: Block) -> tuple[float, ...]:
    """1, length, end of a sentence, heading, share of links."""
    return 1.0, min(len(b.text), FULL) / 100, float(b.text[-1] in ".!?:;\"'”»。"), float(b.tag in ("h1", "h2", "h3")), b.links


def score(b: Block, marked: bool = True, model: Model = Model()) -> int:
    """Log-odds of a block; ``marked``: the page marks its article or main part, which the others then aren't."""
    weights = (BIAS if marked else UNMARKED, LENGTH, SENTENCE, HEADING, LINKS)
    s = sum((w + shift) * x for w, shift, x in zip(weights, model.text, text_features(b), strict=True))
    s += sum(model.names[k] for k in b.names) + b.named
    for flag, weight in ((_ARTICLE, IN_ARTICLE), (_MAIN, IN_MAIN), (_ASIDES, IN_ASIDE), (_HEADER, IN_HEADER)):
        if b.flags & flag:
            s += weight
    return round(s)


def min_cut(own: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    ``own`` is capacity from the source (positive) or to the sink (negative);
    of equal cuts, the one with fewest nodes on the source's side is taken.
    """
    near: dict[int, dict[int, int]] = {v: {} for v in range(len(own))}
    for (a, b), w in edges.items():
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    inside = _flow(near, own)
    return [v in inside for v in range(len(own))]


def _flow(near: dict[int, dict[int, int]], own: list[int]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (Dinic)."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {v: dict(e) for v, e in near.items()}
    room[source], room[sink] = {}, {}
    for v in near:
        if own[v] > 0:
            room[source][v], room[v][source] = own[v], 0
        elif own[v] < 0:
            room[v][sink], room[sink][v] = -own[v], 0
    while True:
        level, layer = {source: 0}, [source]
        while layer and sink not in level:
            following = []
            for v in layer:
                for u, w in room[v].items():
                    if w > 0 and u not in level:
                        level[u] = level[v] + 1
                        following.append(u)
            layer = following
        if sink not in level:
            return set(level) - {source}
        ways = {v: iter(list(room[v])) for v in room}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= least
                    room[b][a] += least
                path = [source]  # edges passed over in this round come back in the next
                continue
            for u in ways[v]:
                if room[v][u] > 0 and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                level[v] = -1
                path.pop()


def smoothness(found: list[Block]) -> dict[tuple[int, int], int]:
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    sides = _ASIDES | _HEADER
    for k, b in enumerate(found):

        def weight(w: int, j: int, b: Block = b) -> int:
            a = found[j]
            return w if a.flags & sides == b.flags & sides and a.named == b.named else int(w * OTHER_MARKS)

        if k:
            a = found[k - 1]
            near = SAME_PARENT if a.parent == b.parent else SAME_GRANDPARENT if a.grandparent == b.grandparent or b.grandparent == a.parent or a.grandparent == b.parent else NEXT
            edges[k - 1, k] = weight(near, k - 1)
        before = last.get(b.parent)
        if before is not None:
            edges[before, k] = edges.get((before, k), 0) + weight(SIBLING, before)
        last[b.parent] = k
    return edges


def main_text(page: str | None, model: Model = Model()) -> str:
    found = blocks(page or "")
    marked = any(b.flags & (_ARTICLE | _MAIN) for b in found)
    labels = min_cut([score(b, marked, model) for b in found], smoothness(found))
    return "\n".join([b.text for b, content in zip(found, labels, strict=True) if content])


@tidy
def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the blocks whose elements tell their label."""
    for batch in batches:
        for part in pieces(batch, "html"):
            label, features, names = [], [], []
            for page in part.column("html"):
                for b in blocks(page.as_py() or ""):
                    content, side = bool(b.flags & (_ARTICLE | _MAIN)), bool(b.flags & (_ASIDES | _HEADER)) or b.named <= NAMED
                    if content != side:
                        label.append(content)
                        features.append([round(x, 2) for x in text_features(b)])
                        names.append(b.names)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.bool_()), pa.array(features, pa.list_(pa.float64())), pa.array(names, pa.list_(pa.int32()))], ["label", "features", "names"])


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Model:
    """The classifier fitted to about ``sample`` pages, drawn by a hash of id and html; without both labels, as it is given."""
    n = pages.count()
    if not n:
        return Model()
    draw = F.pmod(F.xxhash64(F.lit("page sample"), "page_id", "html"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = pages.where(draw < min(1.0, sample / n)).select("html")
    rows = drawn.mapInArrow(_examples, "label boolean, features array<double>, names array<int>")
    kinds = rows.groupBy("label", "features", "names").count().toPandas()
    if kinds["label"].nunique() < 2:
        return Model()
    kinds = kinds.iloc[np.lexsort((kinds["features"].map(str), kinds["label"]))]
    y = kinds["label"].to_numpy(float)
    text = np.stack(kinds["features"].tolist())
    names = kinds["names"].tolist()
    times = kinds["count"].to_numpy(float)
    for label in (0.0, 1.0):
        times[y == label] *= PRIOR_BLOCKS / 2 / times[y == label].sum()
    size = _TEXT_FEATURES + NAME_BUCKETS
    given = np.zeros(size)
    given[:_TEXT_FEATURES] = np.array([BIAS, LENGTH, SENTENCE, HEADING, LINKS]) / 100

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient and curvature of the loss, from ``FIT_ROWS`` rows at a time."""
        slope, bend = np.zeros(size), np.zeros((size, size))
        for at in range(0, len(y), FIT_ROWS):
            part = slice(at, at + FIT_ROWS)
            x = np.zeros((len(y[part]), size))
            x[:, :_TEXT_FEATURES] = text[part]
            for row, own in zip(x, names[part], strict=True):
                row[_TEXT_FEATURES + np.array(own, int)] = 1
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (times[part] * (p - y[part]))
            bend += (x * (times[part] * p * (1 - p))[:, None]).T @ x
        return slope, bend

    w = given.copy()
    for _ in range(25):  # Newton's method; the penalty makes the problem strongly convex
        slope, bend = sums(w)
        step = np.linalg.solve(bend + np.eye(size), slope + (w - given))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    shift = np.rint(100 * (w - given)).astype(int).tolist()
    return Model(tuple(shift[:_TEXT_FEATURES]), tuple(shift[_TEXT_FEATURES:]))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html); without a model it is fitted to them."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = fit(rows) if model is None else model

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(h.as_py(), model) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
