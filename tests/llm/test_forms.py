"""Forms of web pages, rows of odd ids, and a fit in blocks."""

import pandas as pd
import pytest

from tests.llm.test_operators import brute_repeats, by_sql, frame
from waymark.llm import op2_repeats, op9_chat, op10_html
from waymark.llm.op10_html import blocks, main_text

LONG = "This is a paragraph of an article that says something in whole sentences, and goes on for more than a hundred letters."
MENU = "<div class='menu'><a href=a>Home</a> <a href=b>News</a></div>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<form id='aspnetForm'>{MENU}<article><h1>Head</h1><p>{LONG}</p></article></form>", f"Head\n{LONG}"),
        (f"<form>{MENU}<div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{LONG}\n{LONG}"),
        (f"<form><fieldset>{MENU}<div><p>{LONG}</p><p>{LONG}</p></div></fieldset></form>", f"{LONG}\n{LONG}"),
        ("<form><article><p>Short text.</p></article></form>", "Short text."),
        (f"<article><p>{LONG}</p><form>Name <input> Your comment <textarea></textarea><p>We print what fits.</p></form></article>", LONG),
        (f"<div><p>{LONG}</p><p>{LONG}</p></div><form><p>{LONG}</p></form>", f"{LONG}\n{LONG}"),
        (f"<form>{MENU}<div><p>{LONG}</p><p>{LONG}</p></div><form><p>Subscribe</p></form></form>", f"{LONG}\n{LONG}"),
        ("<form><label>Name <input></label> <button>Send</button></form>", ""),
    ],
)
def test_forms(page, text):
    assert main_text(page) == text


def test_all_names_count():
    names = " ".join(f"n{k}" for k in range(40))
    assert len(blocks(f"<div class='{names}'><p>text</p></div>")[0].names) > 16


def test_a_fit_in_blocks_is_the_fit(spark, monkeypatch):
    page = lambda k: f"<nav class='menu m{k % 3}'><a href=x>Go {k}</a></nav><article><h1>Head {k}</h1><p>{LONG} {k}</p></article><footer>Foot {k}</footer>"
    pages = spark.createDataFrame([(k, "u", page(k)) for k in range(60)], "page_id long, url string, html string")
    whole = op10_html.fit(pages)
    monkeypatch.setattr(op10_html, "FIT_ROWS", 7)
    assert op10_html.fit(pages) == whole and any(whole.text)


def test_a_conversation_of_the_probes_number(spark, tmp_path):
    rows = [(-7, 0, "user", "first"), (-7, 1, "assistant", "its own answer"), (-7, None, None, None), (3, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    given = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64", "role": "string", "text": "string"})
    assert frame(op9_chat.op9_chat_format(spark, str(tmp_path)).toPandas()) == by_sql(op9_chat.SQL, conversations=given)


def test_many_rows_without_an_id(spark):
    rows = [(None, f"{LONG} {k % 5}") for k in range(300)] + [(4, LONG), (9, "short")]
    got = op2_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    high = lambda r: (10**6 if r[0] is None else r[0], *r[1:5])
    assert sorted(high(r) for r in got.collect()) == brute_repeats([high(r) for r in rows])
