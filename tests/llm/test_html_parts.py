"""Attributes, forms and names: what is article text although a word in the markup says otherwise."""

from __future__ import annotations

import pytest

from spanloom.llm import html_main
from spanloom.llm.html_main import main_text

FIRST, LAST = "Some first sentence, with a comma.", "Another sentence, the last of all."


def page(inner):
    return f"<body><nav><a href='/'>home</a></nav><article><p>{FIRST}</p>{inner}<p>{LAST}</p></article><footer>Foot.</footer></body>"


KEPT = [
    ("<p>See <a href='/the-hidden-valley'>the valley</a> now.</p>", "See the valley now."),
    ("<p>Read <a href='/p?id=comments'>the remarks</a> now.</p>", "Read the remarks now."),
    ("<div title='The hidden life'>Of that life, a line.</div>", "Of that life, a line."),
    ("<p data-hidden='false'>A line, not hidden.</p>", "A line, not hidden."),
    ("<p data-role='search'>A line, no search.</p>", "A line, no search."),
    ("<div data-x=\"a class='ads' b\">A line, no advert.</div>", "A line, no advert."),
    ("<section class='copyright'>On copyright law, as it stood then, and why it changed.</section>", "On copyright law, as it stood then, and why it changed."),
    ("<div class='discussion'>A discussion of results, point by point, as usual.</div>", "A discussion of results, point by point, as usual."),
    ("<ul><li class='item related'>A related case, which was heard later, is this one.</li></ul>", "A related case, which was heard later, is this one."),
]


@pytest.mark.parametrize("inner, want", KEPT)
def test_article_text_stays(inner, want):
    assert main_text(page(inner)) == f"{FIRST}\n{want}\n{LAST}"


GONE = ["<div class='ad'>Buy now, it is cheap.</div>", "<p hidden>Not seen, at all.</p>", "<div HIDDEN=''>Not seen, at all.</div>", "<div style=\"color: red; display : none\">Not seen, at all.</div>", "<div class='comments'><p>Nice text, thanks.</p></div>",
        "<ul class='related'><li><a href='a'>One</a></li><li><a href='b'>Two</a></li></ul>", "<form action='/s'><p>Subscribe to our letter, now.</p><input name=q></form>", "<div role='search'>Find it, here.</div>", "<div class='s&#104;are'><a href='x'>Share</a></div>"]


@pytest.mark.parametrize("inner", GONE)
def test_the_rest_goes(inner):
    assert main_text(page(inner)) == f"{FIRST}\n{LAST}"


def test_forms_around_a_page():
    inner = page("<form><label>Search</label><input></form>").removeprefix("<body>").removesuffix("</body>")
    assert main_text(f"<body><form id='aspnetForm' method=post>{inner}</form></body>") == f"{FIRST}\n{LAST}"
    sentences = [f"Sentence {i}, with a comma and words." for i in range(5)]
    bare = "<body><form id='f'><div>" + "".join(f"<p>{x}</p>" for x in sentences) + "</div></form><form><p>Log in, please.</p></form></body>"
    assert main_text(bare) == "\n".join(sentences)


def naive(html):
    """What stands between the paragraph and title tags of a page's article."""
    import html as entities
    import re

    found = re.search(r"<article[^>]*>(.*?)</article>", html, re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", found[1]) if found else []
    texts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_equals_a_second_extractor(spark):
    rows = html_main.op4_html(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) > 200 and all(r.text == naive(r.html or "") and r.n_chars == len(r.text) for r in rows)


def test_ratios_decide_inside_an_article(monkeypatch):
    inner, want = KEPT[7]
    assert want in main_text(page(inner + "<div class='follow'>Us</div>")) and "Us" not in main_text(page(inner + "<div class='follow'>Us</div>")).split("\n")
    plain = html_main.path_ratios
    monkeypatch.setattr(html_main, "path_ratios", lambda b, p: dict.fromkeys(plain(b, p), 1.0))
    assert "Us" in main_text(page(inner + "<div class='follow'>Us</div>")).split("\n")
