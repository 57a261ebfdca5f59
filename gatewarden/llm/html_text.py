"""Main text of web pages by consensus host paths.

Every container of a page, up to the outermost, is scored by the text of all blocks below it, less a multiple of
what reads like boilerplate there; pages vote for the generalised tag and class paths of their containers, and
the votes of a host are summed in Spark.  So a path is left for a wider one where the further blocks are text,
and kept where they are boilerplate.  A second pass takes the blocks below the host's winning path, or below the
page's own best container where it has none.

What is no main text goes by structure: elements that say so (nav, footer, form, ...), hidden ones, and those whose
class, id or role consists of nothing but names of such parts ("cookie-notice", not "search-algorithms"), unless
they hold the page's main element or headline.

Paths and hosts go by 64-bit hashes: two hosts that shared one would vote together.  A page is read in time
proportional to its length, however broken its markup.

Cases: null or empty html gives an empty text; null urls share one host; repeated rows are pages of their own;
null ids are kept.  Broken markup: a tag that never ends is text; an unclosed comment, script or style reaches to
the end, of other unclosed elements without text only the tag goes; a quote that is never closed does not hide the
end of its tag.  An empty table gives no rows; only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, salted, table
from .substring_dedup import small_batches

#: Hosts whose winners may be broadcast (16 bytes each); beyond, pages meet them in this many shares of a host.
MOST_BROADCAST, SHARES = 500_000, 32
#: Characters of text that one of boilerplate outweighs; shortest text that counts without a paragraph or a sentence.
WEIGHT, SHORT = 3, 40

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag: quotes count only where a value begins.
_REST = re.compile(r"(?>[^>\"'=]+|=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?|[\"'])*+>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
#: Elements whose content is no text of the page, and those of them that end with the page if nothing closes them.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea svg iframe select title button".split()}
UNCLOSED = ("script", "style")
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul head".split()
)
#: Elements that hold no main text.
BOILER = frozenset("nav header footer aside form dialog menu head".split())
#: Words that name other parts of a page in a class, id or role.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager skip legal copyright disclaimer complementary contentinfo search".split()
)
#: Words that may stand beside these in such a name.
PARTS = frozenset(
    "a area b bar block body bottom box btn button buttons by c center col column container content count desktop div entry field fixed floating form frame global google grid group holder icon icons inner item items left link links list main media mobile module outer panel post posts primary region right row secondary section side site slot small sticky story the thread title top unit us wrap wrapper zone article articles message messages policy user users reader readers page id class js".split()
)
#: With a header these name the article's own.
OWN = frozenset("article main post entry story content".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_WS = re.compile(r"\s+")
_CONTAINERS = frozenset("html body main article section div td blockquote center".split())
#: Elements whose text counts however short it is.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th caption figcaption address summary".split())
_SENTENCE = re.compile(r"[.!?…:;][\"'”»’)]*$")
_NOTICE = re.compile(r"^\W*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)
#: Where an element that opens closes an earlier one of its kind: the kinds, and the elements beyond which it does not.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("optgroup",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
_TEXT_ONLY = ("p", "h1", "h2", "h3", "h4", "h5", "h6")


def attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(s):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def marked(named: dict[str, str]) -> bool:
    """Whether a class, the id or the role names nothing but a part that is not main text."""
    for name in (*named.get("class", "").split(), named.get("id", ""), named.get("role", "")):
        words = set(_WORDS.findall(_CAMEL.sub("-", name).lower())) if name else ()
        marks = words & MARKS if words else ()
        if marks and words <= MARKS | PARTS and not (marks == {"header"} and words & OWN):
            return True
    return False


def hidden(named: dict[str, str]) -> bool:
    """Whether an attribute hides the element; names and values that merely contain the word do not."""
    return named.get("hidden", "false").strip().lower() not in ("until-found", "false") or named.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(named.get("style", "")))


def step_name(tag: str, named: dict[str, str]) -> str:
    """Tag and classes of an element; numbers in names become one sign."""
    return ".".join([tag, *sorted({_DIGITS.sub("#", c) for c in named.get("class", "").lower().split()})])


def tags(html: str):
    """(start, end, closing, name, attributes) of every tag; other markup and elements without text have no name."""
    at, n, last, quotes, unclosed = 0, len(html), html.rfind(">"), True, set()
    while (i := html.find("<", at)) >= 0:
        c = html[i + 1 : i + 2]
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            at = n if j < 0 else j + 3
            yield i, at, False, "", ""
            continue
        if i > last:
            return
        if c in ("!", "?"):
            end = "]]>" if html.startswith("<![CDATA[", i) else ">"
            j = html.find(end, i)
            at = n if j < 0 else j + len(end)
            yield i, at, False, "", ""
            continue
        m = _NAME.match(html, i + 1 + (c == "/"))
        if not m:
            at = i + 1
            continue
        r = _REST.match(html, m.end()) if quotes and c != "/" else None
        if r is None:
            quotes = quotes and c == "/"
            j = html.find(">", m.end())
            if j < 0:
                return
            at = j + 1
        else:
            at = r.end()
        name, rest = m[0].lower(), html[m.end() : at - 1]
        if c != "/" and name in RAW:
            if not (name == "svg" and rest.endswith("/")) and name not in unclosed:
                stop = RAW[name].search(html, at)
                if stop:
                    at = stop.end()
                elif name in UNCLOSED:
                    at = n
                else:
                    unclosed.add(name)
            name = ""
        yield i, at, c == "/", name, rest


class Page:
    """Blocks of a page in order: (path, text, characters within links, innermost tag).  Paths are numbers of nodes;
    ``parent``, ``steps``, ``depth`` and ``names`` (64-bit hashes of whole paths) belong to the nodes, 0 is the root."""

    def __init__(self, html: str):
        self.parent, self.steps, self.depth, self.names = [-1], [""], [0], [0]
        self.known: dict[tuple[int, str], int] = {}
        found, regions = [], [(-1, [False])]  # regions: marked elements, and whether they hold the main element or headline
        stack: list[tuple[str, int, bool, int]] = []  # (tag, node, without main text, region)
        text, links, at, dead, in_link, own, opened = [], 0, 0, 0, False, 0, Counter()

        def flush():
            nonlocal links
            if text:
                t = _WS.sub(" ", unescape("".join(text))).strip()
                if t:
                    found.append((stack[-1][1] if stack else 0, t, links, stack[-1][0] if stack else "", stack[-1][3] if stack else 0))
                text.clear()
            links = 0

        def pop_to(i):
            nonlocal dead, own
            flush()
            while len(stack) > i:
                tag, _, gone, _ = stack.pop()
                opened[tag] -= 1
                dead -= gone
                own -= tag in ("article", "main")

        for start, end, closing, tag, rest in tags(html):
            if start > at and not dead:
                text.append(html[at:start])
                if in_link:
                    links += len(html[at:start].strip())
            at = end
            if tag == "a":
                in_link = not closing
            elif tag == "br" and not dead:
                text.append(" ")
            if tag not in BLOCKS:
                continue
            if closing:
                if opened[tag]:
                    pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                else:
                    flush()
                continue
            flush()
            if tag == "hr":
                continue
            if stack and stack[-1][0] in _TEXT_ONLY:
                pop_to(len(stack) - 1)  # a paragraph or heading ends where the next block begins
            if tag in _SIBLINGS:
                same, beyond = _SIBLINGS[tag]
                if any(opened[s] for s in same):
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in beyond:
                            break
                        if stack[i][0] in same:
                            pop_to(i)
                            break
            if tag == "body" and opened["head"]:
                pop_to(next(i for i, s in enumerate(stack) if s[0] == "head"))
            named = attributes(rest) if rest.strip(" /") else {}
            up, region = (stack[-1][1], stack[-1][3]) if stack else (0, 0)
            gone = tag in BOILER and not (tag == "header" and own) or bool(named) and tag not in ("html", "body") and hidden(named)
            if not gone and not dead:
                if named and tag not in ("html", "body", "main") and marked(named):
                    regions.append((region, [False]))
                    region = len(regions) - 1
                elif tag in ("main", "h1"):
                    r = region
                    while r > 0 and not regions[r][1][0]:
                        regions[r][1][0] = True
                        r = regions[r][0]
            stack.append((tag, self.node(up, step_name(tag, named)), gone, region))
            opened[tag] += 1
            dead += gone
            own += tag in ("article", "main")
        if at < len(html) and not dead:
            text.append(html[at:])
        flush()
        drop = [False]
        for above, (holds,) in regions[1:]:
            drop.append(drop[above] or not holds)
        self.blocks = [b[:4] for b in found if not drop[b[4]]]

    def node(self, up: int, step: str) -> int:
        i = self.known.get((up, step))
        if i is None:
            i = self.known[up, step] = len(self.steps)
            self.parent.append(up)
            self.steps.append(step)
            self.depth.append(self.depth[up] + 1)
            h = blake2b(self.names[up].to_bytes(8, "little", signed=True) + step.encode("utf-8", "replace"), digest_size=8).digest()
            self.names.append(int.from_bytes(h, "little", signed=True))
        return i

    def scores(self) -> tuple[list[float], float]:
        """What all blocks below each node are worth, and the sum of what is text."""
        value, total = [0.0] * len(self.steps), 0.0
        for node, t, links, tag in self.blocks:
            w = worth(t, links, tag)
            value[node] += w
            total += max(0.0, w)
        for i in range(len(value) - 1, 0, -1):
            value[self.parent[i]] += value[i]
        return value, total

    def containers(self):
        """Nodes that may hold an article; the root stands for texts without a common one."""
        return [i for i, s in enumerate(self.steps) if not i or s.split(".")[0] in _CONTAINERS]

    def below(self, node: int) -> list[str]:
        inside = [i == node for i in range(len(self.steps))]
        for i in range(node + 1, len(inside)):
            inside[i] = inside[self.parent[i]]
        return [t for i, t, _, _ in self.blocks if inside[i]]


def worth(text: str, links: int, tag: str) -> float:
    """Characters of a block outside links; boilerplate counts against its container."""
    if 2 * links > len(text) or _NOTICE.search(text) or (tag not in _PROSE and len(text) < SHORT and not _SENTENCE.search(text)):
        return -float(WEIGHT * len(text))
    return len(text) - 2.0 * links


def _vote(batches):
    import pyarrow as pa

    for batch in batches:
        votes: dict[tuple[int, int, int], float] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            page = Page(html or "")
            value, total = page.scores()
            if total > 0:
                for i in page.containers():
                    k = host, page.names[i], page.depth[i]
                    votes[k] = votes.get(k, 0.0) + value[i] / total
        rows = [(*k, v) for k, v in votes.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.float64()])], names=["host", "path", "depth", "votes"])


def main_text(html: str | None, winner: int | None = None) -> str:
    """Blocks below the winning path, or below the page's own best container, one a line."""
    page = Page(html or "")
    chosen = page.below(page.names.index(winner)) if winner is not None and winner in page.names else []
    if not chosen:
        value, _ = page.scores()
        # of containers of equal worth the innermost, which holds the least besides
        chosen = page.below(max(page.containers(), key=lambda i: (value[i], page.depth[i], -i)))
    return "\n".join(chosen)


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h, p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "html")
    host = F.xxhash64(F.coalesce(F.lower(F.regexp_extract("url", r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    with small_batches(spark):
        votes = pages.select("host", "html").mapInArrow(_vote, "host long, path long, depth int, votes double").groupBy("host", "path", "depth").agg(F.sum("votes").alias("votes"))
        # votes are rounded before they are compared: their sums depend on the order of addition in the last digits
        winners = votes.groupBy("host").agg(F.max_by("path", F.struct(F.round("votes", 6), F.col("depth"), F.col("path"))).alias("path"))
        winners = scratch.write(winners, "winners")
        if winners.count() <= MOST_BROADCAST:
            joined = pages.join(F.broadcast(winners), "host", "left")
        else:  # pages of one host meet its winner in several tasks
            joined = salted(pages, winners, "host", "page_id", SHARES, "left")
        out = scratch.write(joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string"), "out")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
