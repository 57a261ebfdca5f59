"""Page text: pages without an article element, names that look like boilerplate, broken markup in linear time."""

import re
import time
from html import unescape

import pytest

from gatewarden.llm import html_text
from gatewarden.llm.html_text import Page, attributes, extract, main_text, marked

SCHEMA = "page_id long, url string, html string"
TAIL = "Rest is long enough to be an article of its own. " * 20


@pytest.mark.parametrize("open_, close", [("<div class='c'>", "</div>"), ("<div id=x><div class='story-7'>", "</div></div>"), ("<main><section>", "</section></main>"), ("<table><tr><td>", "</td></tr></table>"), ("", "")])
def test_pages_without_article(spark, data, open_, close):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    df = spark.createDataFrame([(r["page_id"], r["url"], r["html"].replace("<article>", open_).replace("</article>", close)) for r in rows], SCHEMA)
    got = {r["page_id"]: r["text"] for r in extract(df).collect()}
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        want = "\n".join(w for w in (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", p))).strip() for p in re.split(r"</?(?:p|h1|article)>", inner)) if w)
        assert got[r["page_id"]] == want


def test_more_hosts_than_may_be_broadcast(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}/x", f"<div class=a><p>{TAIL}</p></div>") for i in range(20)] + [(None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(str, extract(df).collect()))
    monkeypatch.setattr(html_text, "MOST_BROADCAST", 0)
    assert sorted(map(str, extract(df).collect())) == want and len(want) == 21


def test_sections_and_names_of_an_article():
    body = "<h1>T</h1><section class='intro'><p>Intro it is.</p></section><section class='rest'><p>" + TAIL + "</p></section>"
    odd = "<div class='search-algorithms'>Text on search.</div><div id=social-history>Social text.</div><p class='legal-basis'>Legal.</p>"
    gone = "<div class='cookie-notice'>We use cookies.</div><div class='ad-slot-3'>Buy this.</div><section id='comments'><article class='comment'><p>Reader says.</p></article></section><div role='navigation'>More of it.</div>"
    got = main_text(f"<body><article>{body}{odd}{gone}</article></body>").split("\n")
    assert got == ["T", "Intro it is.", TAIL.strip(), "Text on search.", "Social text.", "Legal."]
    # a name does not count against an element that holds the page's main element
    assert main_text(f"<body><div class='sidebar-left'><main><p>{TAIL}</p></main></div></body>") == TAIL.strip()


def test_names():
    m = lambda s: marked(attributes(s))
    assert all(map(m, ("class='x navBar'", "id=comments", "class='related-posts'", "class=post-comments", "role=banner", "class='site-header'")))
    assert not any(map(m, ("class='entry-header'", "class='no-sidebar-layout'", "data-id=ad", "class='cookies-recipe'", "class=''")))


def test_quotes():
    assert main_text("<p title=it's>hello there</p><p>don't stop</p><p>end</p>") == "hello there\ndon't stop\nend"
    assert main_text('<p title="a>b">one.</p><p "x>two.</p><p a=\'never closed>three.</p>') == "one.\ntwo.\nthree."
    assert main_text("<p>one < two <b and</p><p>three.") == "one < two\nthree."


@pytest.mark.parametrize("part", ["<a ", '<a x="', "<div>", "<div>x", "<svg>", "<!-- ", "<li>", "<div><li>a", "<p title='", "</x", "<", '<a b="c>', '"=', '<p class="a>b'])
def test_broken_markup_in_linear_time(part):
    t = time.time()
    for html in (part * (1_000_000 // len(part)), "<p>a</p><a " + part * (500_000 // len(part)) + ">"):
        Page(html).scores()
    assert time.time() - t < 30
