"""Main text of web pages by the maximum-scoring contiguous region.

A page becomes a row of tokens: runs of words and tags. Words and tags have weights learned as smoothed log-odds on labelled pages: words
by the kind of the container they stand in (an article, a menu, an advert, ...), whether they are link text, and how many stand in their run;
tags by their name. Words of content score above 0, tags below. One linear scan (Kadane) finds the contiguous region of the highest
total; what lies in a container kind of negative weight inside that region (an advert in an article, say) is left out.

The labelled pages are ``LABELLED``, written by hand, and ``COMPOSED`` pages put together by rule from parts of many make-ups: with and without an article
element, with named and with unnamed containers, chrome before, inside and after the text. The kind of a container comes from its tag, role,
class or id; a header or a heading's box inside an article is part of it.

Blocks (paragraphs, headings, list items, cells, ...) end at block tags; inside one, white space (also from br and from character references)
becomes one space. Scripts, styles, comments, the head and form controls have no text.

Defined results: null or empty html, and pages whose best region is not above 0, give the empty string. Unclosed or stray tags are
tolerated; an unclosed comment or script runs to the end. Of regions with equal scores the first is taken. Repeated rows repeat; other
columns of the input are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Names of HTML elements, and words of class and id attributes that tell what a container holds.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe audio video canvas textarea select title".split())
CLOSES_P = BLOCKS - {"body", "html"}
KINDS = {
    "article": "article", "main": "article", "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "form": "form", "button": "form", "dialog": "notice", "head": "head",
}
NAMES = {
    "advert": "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner",
    "comments": "comment comments commentlist respond reply replies disqus discussion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "side": "sidebar related recommended widget aside popular trending",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup social share sharing paywall",
    "footer": "footer copyright colophon",
    "header": "masthead topbar header siteheader pageheader topheader mainheader globalheader",
    "form": "search login",
    "article": "article content post entry story articlebody maincontent",
}
ROLES = {"navigation": "menu", "banner": "header", "contentinfo": "footer", "complementary": "side", "search": "form", "main": "article", "article": "article", "alert": "notice", "dialog": "notice"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTR = re.compile(r"""(?:\A|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_NAME_KIND = {w: kind for kind, words in NAMES.items() for w in words.split()}


def container_kind(tag: str, attributes: str, around: str = "plain") -> str | None:
    """What an element is said to hold by its name, role, class or id, standing in a container of a kind; None if nothing."""
    found = None if tag == "header" and around == "article" else KINDS.get(tag)
    if not attributes or (tag not in BLOCKS and tag != "span"):
        return found
    kinds = set()
    for name, *values in _ATTR.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "role":
            kinds.add(ROLES.get(value.lower()))
            continue
        for word in value.split():
            kinds.add(_NAME_KIND.get(re.sub("[-_]", "", word.lower())))
            kinds |= {_NAME_KIND.get(x.lower()) for x in _PARTS.findall(word)} - {"header"}  # a part alone names any box's heading
    if around == "article" or "article" in kinds:
        kinds.discard("header")
    for kind in ("advert", "comments", "notice", "menu", "side", "footer", "header", "form"):  # what is not content goes first
        if kind in kinds:
            return kind
    return found or ("article" if "article" in kinds else None)


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(what, value, kind, in a link): what is "text", "block" (a block's edge), "space" (br) or "tag" (another tag)."""
    stack: list[tuple[str, str]] = []
    kind, links, at, n = "plain", 0, 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if (end := m.start() if m else n) > at:
            yield "text", page[at:end], kind, links > 0
        if not m:
            return
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in SILENT:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if name == "br":
            yield "space", " ", kind, links > 0
            continue
        if name == "a":
            links = 0 if closing else 1
        if name in CLOSES_P:
            links = 0
        if name not in VOID and (name in BLOCKS or name in KINDS):
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        del stack[i:]
                        break
            elif name != "p":
                stack.append((name, container_kind(name, attributes, kind) or kind))
            kind = stack[-1][1] if stack else "plain"
        yield "block" if name in BLOCKS else "tag", name, kind, links > 0


def score(token: tuple[str, str, str, bool], weights: dict[str, float]) -> float:
    what, value, kind, link = token
    if what == "text":
        n = len(value.split())
        return n * weights[f"word {kind} {'link' if link else 'text'} {_length(n)}"] if n else 0.0
    return 0.0 if what == "space" else weights.get(f"tag {value}", weights["tag"])


def _length(words: int) -> str:
    return "short" if words < 4 else "middling" if words < 10 else "long"


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region."""
    items = list(tokens(page or ""))
    best = (0.0, 0, 0)
    total, start = 0.0, 0
    for i, token in enumerate(items):
        if total <= 0.0:
            total, start = 0.0, i
        total += score(token, weights)
        if total > best[0]:
            best = (total, start, i + 1)
    blocks, run = [], []

    def flush():
        if text := " ".join(html.unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    for what, value, kind, _ in items[best[1] : best[2]]:
        if what == "block":
            flush()
        elif what == "space" or what == "text" and weights[f"word {kind} text"] > 0:
            run.append(value)
    flush()
    return "\n".join(blocks)


# Labelled pages: text between ⟦ and ⟧ is main text.
LABELLED = (
    '<html><head><title>Rain</title></head><body><header><a href="/">Daily</a> <span>News of the town</span></header><nav><ul><li><a>Home</a></li><li><a>Sport</a></li><li><a>Arts and more</a></li></ul></nav><article>⟦<h1>Rain after weeks of sun</h1><p>Farmers in the valley saw the first rain in six weeks on Sunday night.</p><p>The river rose by a hand, and the <a>mill at the bridge</a> is turning again.</p>⟧<div class="ad">Buy boots now and save half</div>⟦<p>More rain is likely before the end of the week.</p>⟧</article><footer>Copyright Daily, all rights reserved. <a>Terms</a> <a>Contact</a></footer></body></html>',
    '<html><body><div class="cookie-notice">We use cookies to make the site better for you. <a>Accept</a></div><div id="menu"><a>Start</a><a>Shop</a><a>About us</a></div><div id="content">⟦<h2>How to mend a chair</h2><p>Take the seat off first, and clean the joints with warm water and a brush.</p><ul><li>Glue the joint.</li><li>Press it for a night.</li></ul>⟧</div><div class="sidebar"><h3>Related</h3><a>How to mend a table</a><a>Ten tools to have</a></div><div class="comments"><p>Great tips, thank you, I did this with my own chair.</p></div><div id="footer">Made with care since long ago</div></body></html>',
    '<html><body><main>⟦<p>The meeting opened at nine. Minutes of the last meeting were read and approved without change.</p><table><tr><td>Votes for</td><td>twelve</td></tr><tr><td>Votes against</td><td>three</td></tr></table><p>The next meeting is on the first Monday of the month.</p>⟧<form><label>Write to us</label><input></form></main><aside><p>Join the club today and get a free mug.</p></aside><footer><p>Town hall, Main street</p></footer></body></html>',
    '<html><body><p><a>One</a> | <a>Two</a> | <a>Three</a> | <a>Four more links</a></p>⟦<h1>A plain page</h1><p>There is no sign on this page of what is what, but the long sentences with few tags among them are the text that readers come for.</p><p>A second paragraph follows it with as many words as the first one, or nearly so, and one <a>link</a>.</p><div>Even plain boxes can hold sentences that belong to the text of the page.</div>⟧<p><a>Back</a> <a>Next</a> <a>Top of page</a></p><div class="share">Share this page</div></body></html>',
)
#: How many composed pages weights are learned from.
COMPOSED = 400
_SMOOTH, _MOST = 0.5, 3.0


def composed(seed: int) -> str:
    """A labelled page put together by rule: what stands before, in, between and after its main text, and how each part is marked up."""
    r = random.Random(seed)
    words = "the of and to in that it was for on are as with they at be this from have or one had by word but not what all were we when your can said there use each which do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number way could people".split()
    say = lambda low, high: " ".join(r.choice(words) for _ in range(r.randint(low, high)))
    link = lambda low=1, high=3: f'<a href="/x">{say(low, high)}</a>'
    box = lambda options, body: (lambda o: f"<{o}>{body}</{o.split()[0]}>")(r.choice(options))
    main = lambda body: f"⟦{body}⟧"

    def menu() -> str:
        items = [link() for _ in range(r.randint(3, 9))]
        body = r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<p>{x}</p>" for x in items)])
        return box(["nav", 'div class="menu"', 'div id="navbar"', "div", "div", "p", 'ul class="breadcrumbs"', 'div role="navigation"'], body)

    def chrome() -> str:
        kind = r.randrange(5)
        if kind == 0:
            return box(["header", 'div class="site-header"', 'div id="masthead"', 'div role="banner"', "div"], f"<div>{say(1, 4)}</div>" + r.choice(["", f"<p>{say(3, 8)}</p>"]))
        if kind == 1:
            return box(['div class="cookie-notice"', 'div role="alert"', 'div id="newsletter-popup"', "dialog"], f"{say(5, 20)} {link()}")
        if kind == 2:
            return box(['div class="ad"', 'div class="sponsored box"', 'section id="advertisement"'], r.choice([say(3, 25), f"<p>{say(5, 20)}</p>{link()}"]))
        if kind == 3:
            return box(["aside", 'div class="sidebar"', 'div class="related posts"', 'div role="complementary"'], f"<h3>{say(1, 3)}</h3>" + "".join(f"<p>{link(2, 7)}</p>" for _ in range(r.randint(1, 5))) + r.choice(["", f"<p>{say(6, 25)}</p>"]))
        return box(["form", 'div class="search-box"'], f"<label>{say(1, 4)}</label><input><button>{say(1, 2)}</button>")

    def paragraph() -> str:
        body = " ".join(r.choice([say(6, 30), say(8, 30), say(8, 30), f"<b>{say(1, 3)}</b>", link()]) for _ in range(r.randint(2, 6)))
        return r.choice([f"<p>{body}</p>"] * 8 + [f"<blockquote>{body}</blockquote>", f"<div>{body}</div>", "<ul>" + "".join(f"<li>{say(2, 12)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", f"<h2>{say(2, 6)}</h2><p>{body}</p>", f"<table><tr><td>{say(1, 5)}</td><td>{say(1, 6)}</td></tr></table>", f"<pre>{say(4, 20)}</pre>"])

    holder = r.choice(["article", "article", "main", 'div id="content"', 'div class="post entry"', "div", "div", "section", "body"])
    title = r.choice([f"<h1>{say(2, 9)}</h1>"] * 3 + [f"<header><h1>{say(2, 9)}</h1></header>", ""])
    if "header" in title and holder not in ("article", "main"):
        title = f"<h1>{say(2, 9)}</h1>"
    pieces = [main(title)] if title else []
    for _ in range(r.randint(2, 12)):
        pieces.append(main(paragraph()))
        if r.random() < 0.08:
            pieces.append(box(['div class="ad"', 'div class="share-buttons"', "aside"], say(2, 12)))
    body = "".join(pieces) if holder == "body" else f"<{holder}>{''.join(pieces)}</{holder.split()[0]}>"
    after = [chrome() for _ in range(r.randint(0, 2))]
    if r.random() < 0.4:
        after.append(box(['div class="comments"', 'section id="comments"', 'ol class="commentlist"'], "".join(f"<div><b>{say(1, 2)}</b><p>{say(4, 40)}</p></div>" for _ in range(r.randint(1, 5)))))
    after.append(box(["footer", 'div id="footer"', 'div role="contentinfo"', "div"], f"{say(2, 8)} {link()} {link()}"))
    before = [chrome() for _ in range(r.randint(0, 2))] + [menu()]
    r.shuffle(before)
    return f"<html><head><title>{say(2, 6)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"


@cache
def learned_weights() -> dict[str, float]:
    """Log-odds of being main text over the labelled pages, ``_MOST`` at most either way; of tags, -0.1 at most.

    The weight of a kind's text as a whole ("word kind text") decides what of a region stays.
    """
    inside, outside, names = Counter(), Counter(), set()
    for page in (*LABELLED, *map(composed, range(COMPOSED))):
        main = False
        for what, value, kind, link in tokens(page):
            if what == "text":
                for part in re.split("([⟦⟧])", value):
                    if part in "⟦⟧" and part:
                        main = part == "⟦"
                    elif n := len(part.split()):
                        count, how = (inside if main else outside), f"word {kind} {'link' if link else 'text'}"
                        count[f"{how} {_length(n)}"] += n
                        count[how] += n
            elif what != "space":
                names.add(value)
                (inside if main else outside)[f"tag {value}"] += 1
    odds = lambda key: max(-_MOST, min(_MOST, math.log((inside[key] + _SMOOTH) / (outside[key] + _SMOOTH))))
    out = {}
    for kind in ["plain", "head", *sorted({*KINDS.values(), *NAMES} - {"head"})]:
        for how in ("text", "link"):
            whole = f"word {kind} {how}"
            out[whole] = odds(whole) if inside[whole] + outside[whole] else (-1.0 if kind != "article" else 1.0)
            for length in ("short", "middling", "long"):
                key = f"{whole} {length}"
                out[key] = odds(key) if inside[key] + outside[key] else out[whole]
    out |= {f"tag {name}": min(-0.1, odds(f"tag {name}")) for name in sorted(names)}
    out["tag"] = -0.1  # of no labelled page
    return out


def extractor(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", page: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row; no shuffle."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    bounded_batches(pages.sparkSession)
    return rows.mapInArrow(extractor(weights or learned_weights()), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
