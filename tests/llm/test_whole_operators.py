"""Operators do the whole of their job: what an earlier round cut short."""

import random
import re

import pytest

from gatewarden.llm import fingerprints, html_text


def page(body):
    return f'<html><body><nav><a href="/">Home</a></nav><div class="links"><a href="/a">Other story</a></div>{body}<p>© 2024 A company</p></body></html>'


LONG = "".join(f"<p>Sentence {i} of the long part, which goes on for quite a while.</p>" for i in range(20))
LONG_TEXT = [f"Sentence {i} of the long part, which goes on for quite a while." for i in range(20)]


@pytest.mark.parametrize("inner", ["div", "section", "blockquote"])
def test_nested_article_keeps_headline_and_siblings(spark, inner):
    body = page(f'<article><h1>Headline</h1><p>Lead of it.</p><{inner} class="body">{LONG}</{inner}><div class="more"><p>Last part.</p></div></article>')
    got = {r["text"] for r in html_text.extract(spark.createDataFrame([(i, f"http://h/{i}", body) for i in range(3)], "page_id long, url string, html string")).collect()}
    assert got == {"\n".join(["Headline", "Lead of it.", *LONG_TEXT, "Last part."])}


def test_split_and_deeply_nested_article(spark):
    split = page(f"<main><h1>Headline</h1><div class='a'><div><div><div>{LONG}</div></div></div></div><div class='b'><p>Second half of it.</p></div></main>")
    deep = page("<article><h1>Headline</h1><div><div><div><div><div>" + LONG + "</div></div></div></div></div><p>End of it.</p></article>")
    rows = [(1, "http://s/1", split), (2, "http://d/2", deep), (3, None, "<h1>Bare</h1><div><p>Text of a bare page.</p></div>")]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "\n".join(["Headline", *LONG_TEXT, "Second half of it."]) and got[2] == "\n".join(["Headline", *LONG_TEXT, "End of it."])
    assert got[3] == "Bare\nText of a bare page."


def test_hidden_is_an_attribute_name():
    for shown in (' class="overflow-hidden"', ' data-x="hidden"', ' style="overflow: hidden"', ' hidden="until-found"', ' aria-hidden="false"'):
        assert not html_text.hidden(html_text.attributes(shown))
    for gone in (" hidden", ' hidden=""', ' class="x" HIDDEN', ' style="display: none"', " aria-hidden=true"):
        assert html_text.hidden(html_text.attributes(gone))


def signatures(text):
    w = [x for x in re.split(r"[^\w]|_", text.lower()) if x]
    c = [x for x in w if x not in fingerprints.ANCHORS] + [None, None]
    out, before = {("^", c[0], c[1])} if w else set(), 0
    for i, x in enumerate(w):
        if x in fingerprints.ANCHORS:
            k = i - before
            out.add((x, *(c + [None, None])[k : k + 2]))
            before += 1
    return out


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def test_likeness_is_exact_for_whole_sets(spark):
    r = random.Random(2)
    words = lambda n: " ".join(f"the w{r.randrange(10**6)} x{r.randrange(10**6)}" for _ in range(n))
    a = [words(1) for _ in range(600)]
    b = [*a[:590], *(words(1) for _ in range(10))]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[:20])), (4, ""), (5, "lone"), (6, "Lone!"), (7, "the of")]
    fp = fingerprints.compared(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["doc_id"]: x["near_next"] for x in fp.collect()}
    for i, (d, t) in enumerate(rows):
        assert got[d] == pytest.approx(jaccard(signatures(t), signatures(rows[(i + 1) % len(rows)][1]))), d
    assert 0.9 < got[1] < 1 and 0 < got[2] < 0.05 and got[5] == 1


def test_all_likenesses_equal_brute_force(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = sorted((d, t or "") for d, t in df.collect() if (t or "").isascii())
    ids = {d for d, _ in rows}
    got = {x["doc_id"]: x for x in fingerprints.compared(df.where(df["doc_id"].isin(list(ids)))).collect()}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        s = signatures(t)
        assert got[d]["near_next"] == pytest.approx(jaccard(s, signatures(nxt))) and got[d]["near_edited"] == pytest.approx(jaccard(s, signatures(t[: len(t) - q] + nxt[:q])))
        assert int(got[d]["fingerprint"].split(":")[0], 16) == len(s)


def test_near_pairs_lose_nothing(spark):
    r = random.Random(3)
    sets = [frozenset(r.sample(range(30), r.randrange(0, 30))) for _ in range(60)] + [frozenset(range(n)) for n in (4, 5, 5, 20, 25, 26)]
    rows = [(i, j, (len(x), sorted(x), str(sorted(x))), (len(y), sorted(y), str(sorted(y)))) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j]
    fp = "struct<n:int,all:array<bigint>,name:string>"
    for least in (0.5, 0.8, 1.0 - 1e-6):
        got = {(x["i"], x["j"]): x["likeness"] for x in fingerprints.near_pairs(spark.createDataFrame(rows, f"i int, j int, a {fp}, b {fp}"), "a", "b", least).collect()}
        want = {(i, j): jaccard(sets[i], sets[j]) for i, j, *_ in rows if jaccard(sets[i], sets[j]) >= least}
        assert got == pytest.approx(want) and want
