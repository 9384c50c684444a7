"""Main text that lies outside the largest part of a page, or under a name that only sounds like boilerplate."""

import pytest

from spanloom.llm import html_main

LONG = [f"Sentence number {k} of the long part, with a comma and some more words." for k in range(60)]
SHORT = ["A short section stands here.", "It has two paragraphs."]


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def page(body):
    nav = '<div class="main-nav"><a href="/">Home</a> <a href="/x">News</a></div>'
    return f'<html><body>{nav}<div id="content">{body}</div><div class="site-footer"><p>All rights reserved.</p></div></body></html>'


def test_short_section_beside_a_long_one():
    body = f"<div>{paragraphs(LONG)}</div><div><h2>More</h2>{paragraphs(SHORT)}</div>"
    assert html_main.main_text(page(body)).split("\n") == [*LONG, "More", *SHORT]


@pytest.mark.parametrize("tags", ["ul li", "blockquote p", "table td"])
def test_short_paragraphs_beside_one_long_block(tags):
    outer, inner = tags.split()
    row = ("<tr>", "</tr>") if outer == "table" else ("", "")
    block = "".join(f"{row[0]}<{inner}>{t}</{inner}>{row[1]}" for t in LONG)
    body = f"<p>{SHORT[0]}</p><{outer}>{block}</{outer}><p>{SHORT[1]}</p>"
    assert html_main.main_text(page(body)).split("\n") == [SHORT[0], *LONG, SHORT[1]]


def test_links_inside_an_article_stay():
    sources = '<ul><li><a href="/1">First source</a></li><li><a href="/2">Second source</a></li></ul>'
    text = html_main.main_text(f"<body><article>{paragraphs(LONG)}{sources}</article></body>")
    assert text.split("\n") == [*LONG, "First source", "Second source"]


@pytest.mark.parametrize("name", ["related-work", "side-effects", "follow-up", "search"])
def test_section_with_a_word_of_boilerplate_in_its_id(name):
    text = html_main.main_text(f'<body><article>{paragraphs(LONG)}<section id="{name}">{paragraphs(SHORT)}</section></article></body>')
    assert text.split("\n") == [*LONG, *SHORT]


@pytest.mark.parametrize("name", ["site-header", "cookie-banner", "sidebar-left", "adSlot3", "comments-section", "related-posts", "nav_menu"])
def test_names_of_boilerplate_are_still_known(name):
    text = html_main.main_text(f'<body><div class="{name}">{paragraphs(SHORT)}</div><article>{paragraphs(LONG)}</article></body>')
    inside = html_main.main_text(f'<body><div class="{name}">{paragraphs(SHORT)}</div><div>{paragraphs(LONG)}</div></body>')
    assert text.split("\n") == inside.split("\n") == LONG
