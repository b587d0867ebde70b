from __future__ import annotations

import itertools
import re

import numpy as np
import pytest

from loomwright.llm import html_text as h
from tests.llm.common import SF

COLUMNS = "page_id long, url string, html string, bits string"


@pytest.fixture(scope="module")
def field():
    return h.default_field()


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        field = h.Field(rng.normal(size=(len(h.BITS), 2)), rng.normal(size=(2, 2)) * 2)
        bits = [int(x) for x in rng.integers(0, 2**30, int(rng.integers(1, 7)))]
        emit = [field.scores(b) for b in bits]

        def score(path, emit=emit, field=field):
            return sum(e[p] for e, p in zip(emit, path, strict=True)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path))

        best = max(itertools.product((0, 1), repeat=len(bits)), key=score)
        assert score([int(x) for x in field.decode(bits)]) == pytest.approx(score(best))


def test_held_out_pages(field):
    rng = np.random.default_rng(1234)
    right = total = 0
    for _ in range(200):
        page, content = h.labelled_page(rng)
        own = set(content)
        found = h.blocks(page)
        for (text, _), keep in zip(found, field.decode([b for _, b in found]), strict=True):
            right += keep == (text in own)
            total += 1
    assert right / total > 0.98


#: Pages written by hand, with class names that say nothing, and the blocks of their main text.
NEUTRAL = [
    ("""<html><body><div class="a1"><ul><li><a href="/1">Start</a></li><li><a href="/2">Boats</a></li><li><a href="/3">Maps</a></li></ul></div>
    <div class="b2"><h1>A harbour rebuilt after the storm</h1><p>The old wall gave way in the night, and by the morning half of the quay was gone.</p>
    <p>Masons from three villages came to help; it took them, in all, eleven weeks.</p><p>Today the boats lie where they always did, and few visitors notice the new stones.</p></div>
    <div class="c3"><ul><li><a href="/x">Ten quiet beaches</a></li><li><a href="/y">How to tie a bowline</a></li><li><a href="/z">Ferries in winter</a></li></ul></div>
    <div class="d4">Copyright 2021 Coast Weekly. <a href="/t">Terms</a> <a href="/p">Privacy</a></div></body></html>""",
     ["A harbour rebuilt after the storm", "The old wall gave way in the night, and by the morning half of the quay was gone.", "Masons from three villages came to help; it took them, in all, eleven weeks.", "Today the boats lie where they always did, and few visitors notice the new stones."]),
    ("""<html><body><table><tr><td><a href="/">Home</a> <a href="/r">Recipes</a> <a href="/w">Write to us</a></td></tr></table>
    <div id="k"><h1>Soup of roasted roots</h1><p>Cut the roots into pieces of one size, so that they are done at one time.</p><ul><li>four carrots and two parsnips, peeled and cut into long pieces</li><li>one onion, with its skin, cut in half and roasted beside them</li></ul>
    <p>Roast for an hour, add the stock, and blend until it is smooth; salt it at the end.</p></div>
    <form action="/s"><label>Search</label><input name="q"><button>Go</button></form><div id="m"><a href="/1">Next recipe</a> <a href="/2">Back</a></div></body></html>""",
     ["Soup of roasted roots", "Cut the roots into pieces of one size, so that they are done at one time.", "four carrots and two parsnips, peeled and cut into long pieces", "one onion, with its skin, cut in half and roasted beside them", "Roast for an hour, add the stock, and blend until it is smooth; salt it at the end."]),
    ("""<html><body><div class="q"><a href="/">Logbook</a></div><div class="r"><div class="s"><h1>Why our clocks drift</h1><p>Every cheap quartz has a temperature at which it runs true, and it is seldom that of the room.</p>
    <p>We measured nine of them for a year. Seven were slow in winter, and two were fast.</p><h2>What helps</h2><p>A clock that hears a time signal each night need not be good, only awake at the right moment.</p></div>
    <div class="t"><a href="/a">About</a><br><a href="/b">Archive</a><br><a href="/c">Feed</a></div></div></body></html>""",
     ["Why our clocks drift", "Every cheap quartz has a temperature at which it runs true, and it is seldom that of the room.", "We measured nine of them for a year. Seven were slow in winter, and two were fast.", "What helps", "A clock that hears a time signal each night need not be good, only awake at the right moment."]),
]


def test_pages_written_by_hand(field):
    """Of 15 blocks taken 14 belong to the text (a table of links does not), and none of 14 is missed."""
    taken = right = wanted = 0
    for page, want in NEUTRAL:
        found = h.extract(page, field).split("\n")
        taken, wanted, right = taken + len(found), wanted + len(want), right + sum(b in want for b in found)
    assert right >= 0.9 * taken and right >= 0.95 * wanted


def test_parts_that_are_no_text(field):
    page = """<html><head><title>T</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home page</a><li><a href=/b>Other</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies to make this site work well for you.</p></div>
    <main><article><h1>The &eacute;vent</h1><p>First   part,\n with <b>bold</b> words &amp; more of them.
    <div class="ad"><p>Buy this now, it is very good indeed.</p></div>
    <p>Second part is here, and it ends.</p></article></main>
    <aside><h3>Related</h3><p>Another story you may like to read.</p></aside>
    <form><p>Leave your name and mail.</p><button>Send</button></form>
    <section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this text, thank you very much.</p></div></section>
    <footer>&copy; Site</footer></body></html>"""
    assert h.extract(page, field) == "The évent\nFirst part, with bold words & more of them.\nSecond part is here, and it ends."


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<!--", "<script>", "</p></div>", "<p title='a>b", "&", "<>", "<a" * 50, "<div>" * 3000])
def test_malformed_pages(field, page):
    assert isinstance(h.extract(page, field), str)


def test_raw_text_and_attributes():
    found = [t for t, _ in h.blocks('<p title="a > b">one<script>var t="</p>";</script> two</p><!-- <p>no</p> --><p>three<br>four &lt;5&gt; &am')]
    assert found == ["one two", "three four <5> &am"]


def test_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in h.main_text(spark.read.parquet(f"{SF}/pages.parquet")).collect()}
    assert set(got) == {r.page_id for r in rows}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        parts = [" ".join(h.html.unescape(re.sub(r"<[^>]*(>|\Z)", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1|li|ul)>", article)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_awkward_rows(spark):
    long = "<article>" + "<p>Some words in a row, again and again.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x"), (2, "u", "", None), (3, "u", "no markup at all, only a long line of words that go on and on.", None), (3, "u", "<p>", None), (None, "u", long, None)]
    got = h.main_text(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(got) == 5
    assert [r.text.count("\n") for r in got if r.page_id is None] == [19_999]
    assert all(r.text is not None for r in got)
    assert h.main_text(spark.createDataFrame([], COLUMNS)).count() == 0
