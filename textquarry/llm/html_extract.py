"""HTML main-text extraction by a tree-structured graphical model over DOM nodes.

Every element is a node with a hidden state: content or boilerplate. A node's features (the words of its
class, id and role, how much of its text lies in links, how long its text is) give the evidence; the edge to its
parent gives a potential on the pair of states, by the child's tag. Sum-product messages go up from the leaves and
down from the root, so that every node gets its exact content marginal; text is kept where the marginal of the
element that holds it is at least one half. All potentials are estimated from labelled pages (``labelled_pages``), once, on the driver.

Attribute names speak for what an element is, not for the page's layout: names that say whether something is there
(``has-sidebar``, ``menu-open``) say nothing, nor do names of ``html``, ``body``, ``main`` or of an element that
holds an article and much of the page's text; of headings, paragraphs and other parts of a text only names of their own.

Blocks: text between block-level boundaries is one block; character references are decoded, white space inside a
block becomes one space, blocks are trimmed, empty ones fall away, and the rest is joined in page order by ``\\n``.

Defined cases: null or empty html gives the empty text; html without any element is content; unclosed and stray
tags are repaired as browsers do for paragraphs, list items and table parts; a truncated last tag is dropped, and
with it all that follows a quote which an attribute never closes;
elements may nest to any depth; repeated pages are extracted one by one; further columns pass through.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name

# Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "option": ("option",),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",)}
#: Parts of a larger block, often short in any text, and what a page holds as a whole: their length says nothing.
PARTS = frozenset(
    "html body article main table caption colgroup thead tbody tfoot tr td th dl dt dd h1 h2 h3 h4 h5 h6 hgroup summary details address pre blockquote figure figcaption center fieldset legend".split()
)
#: Text outside anything a reader sees.
UNSEEN = frozenset(
    "script style template noscript head title meta link svg math iframe object canvas audio video button select option optgroup datalist textarea dialog progress meter".split()
)
# Word stems in class, id and role that pages use for parts of a page.
STEMS = (
    "ad", "ads", "advert", "sponsor", "promo", "banner", "nav", "menu", "breadcrumb", "footer", "header", "masthead", "sidebar", "side", "aside",
    "widget", "related", "recommend", "share", "social", "comment", "reply", "discussion", "cookie", "consent", "notice", "alert", "popup", "modal",
    "newsletter", "subscribe", "signup", "login", "search", "form", "pagination", "pager", "tag", "copyright", "legal", "disclaimer", "toolbar",
    "disqus", "respond", "remark", "responses", "opinions", "reviews", "feedback", "conversation", "talkback", "guestbook",
    "adsbygoogle", "taboola", "outbrain", "gdpr", "paywall", "overlay", "interstitial",
    "article", "content", "main", "post", "entry", "story", "body", "text", "title", "headline", "lead", "paragraph", "caption",
    "wrapper", "container", "page", "row", "col", "inner", "section", "complementary", "navigation", "contentinfo", "dialog", "byline", "author",
)

OF_BODY = frozenset("article content main post entry story body text page".split())

#: What an article is called, whose header is part of it.
OF_ARTICLE = frozenset("article post entry story".split())
#: Names of layout and of what a text has itself: they say nothing against an element, and little for a part of a text.
PLAIN = frozenset("title headline lead paragraph caption wrapper container row col inner section byline author".split())
#: A name with one of these words tells whether something is on the page, not what the element is.
STATES = frozenset("has no not with without open opened closed enabled disabled hide show".split())
#: What a stem may end in besides itself: the name is still of that part.
ENDINGS = frozenset("s es list area box bar block wrap wrapper container section item items link links unit holder panel inner content text body title group nav form".split())
#: Of a text's own parts these names tell the place in the layout, no more.
OF_PLACE = frozenset("header side aside banner masthead form tag search row toolbar section dialog legal".split())
#: What names an article element as something else.
OF_OTHERS = frozenset(
    "ad ads advert sponsor promo comment reply discussion remark responses opinions reviews feedback talkback related recommend adsbygoogle taboola outbrain newsletter cookie".split()
)
#: Parts of a text, whose names are of less weight.
TEXT_PARTS = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote figure figcaption pre table caption thead tbody tfoot tr td th dl dt dd details summary address center".split())
#: An element that holds an article and at least this share of the page's text is a wrapper, whatever its names.
WRAPPER_SHARE = 0.4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s>/]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\s*(?:>|/|\s|\Z)", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noscript", "template")}
_WORD = re.compile(r"[a-z]+")


class Node:
    """One element: its parent's number, tag, attribute stems, what text it holds, and whether an article is in it."""

    __slots__ = ("parent", "tag", "stems", "chars", "linked", "own", "depth", "core", "inside", "items")

    def __init__(self, parent: int, tag: str, stems: tuple[str, ...], depth: int, inside: bool = False):
        self.parent, self.tag, self.stems, self.depth, self.inside = parent, tag, stems, depth, inside
        self.chars = self.linked = self.own = 0
        self.core = False
        self.items = 0  # list items below it


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Nodes in page order (a parent before its children), and runs (node, text); text None is a block boundary."""
    nodes, stack = [Node(-1, "#root", (), 0)], [0]
    runs: list[tuple[int, str | None]] = []
    at, size = 0, len(page)
    anchors = 0
    # Places in the stack, by tag and of all that are not inline, so that no search walks a deep stack.
    places: dict[str, list[int]] = {}
    blocks = [0]

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def text(start: int, end: int) -> None:
        if end > start:
            node = nodes[stack[-1]]
            n = len(page[start:end].strip())
            runs.append((stack[-1], page[start:end]))
            node.own += n
            if anchors:
                node.linked += n

    def close(depth: int) -> None:
        nonlocal anchors
        while len(stack) > depth:
            tag = nodes[stack.pop()].tag
            places[tag].pop()
            anchors -= tag == "a"
            if tag not in INLINE:
                blocks.pop()
                runs.append((stack[-1], None))

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            tail = page.rfind("<", at)
            # A tag cut off by the end of the page is markup, not text.
            text(at, tail if tail >= 0 and re.match(r"</?[a-zA-Z]", page[tail:]) else size)
            break
        text(at, m.start())
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not places.get("p"):
                runs.append((stack[-1], None))
            k = last((tag,))
            # An inline element ends only inside the block that it stands in.
            if k and (tag not in INLINE or k > blocks[-1]):
                close(k)
        elif m[2]:
            tag = m[2].lower()
            if tag == "br" or tag == "wbr":
                if tag == "br":
                    runs.append((stack[-1], " "))
                continue
            if tag in CLOSES_P and nodes[stack[blocks[-1]]].tag == "p":
                close(blocks[-1])
            if tag in CLOSED_BY:
                k = last(CLOSED_BY[tag])
                if k > last(SCOPE.get(tag, ())):
                    close(k)
            if tag not in INLINE:
                runs.append((stack[-1], None))
            if tag in VOID:
                continue
            if tag == "body" or tag == "html":
                close(1 + (tag == "body" and len(stack) > 1 and nodes[stack[1]].tag == "html"))
            nodes.append(Node(stack[-1], tag, _stems(m[3]) if m[3] else (), len(stack), bool(places.get("article") or places.get("main"))))
            if m[3].rstrip().endswith("/") and tag in ("svg", "path", "math"):
                continue
            places.setdefault(tag, []).append(len(stack))
            if tag not in INLINE:
                blocks.append(len(stack))
            stack.append(len(nodes) - 1)
            anchors += tag == "a"
            if tag in _RAW_END:
                end = _RAW_END[tag].search(page, at)
                stop = end.start() if end else size
                text(at, stop)
                at = stop
    close(1)
    for k in range(len(nodes) - 1, 0, -1):
        node, up = nodes[k], nodes[nodes[k].parent]
        node.chars += node.own
        up.items += node.tag == "li"
        if node.tag not in UNSEEN:
            up.chars += node.chars
            up.linked += node.linked
            up.core |= node.core or _is_core(node)
    share = WRAPPER_SHARE * nodes[0].chars
    for node in nodes:
        node.stems = _said(node, node.core and node.chars >= share)
    return nodes, runs


def _is_core(node: Node) -> bool:
    """Whether an element is an article's, by its tag or its names."""
    if node.tag in ("h1", "main"):
        return True
    if node.tag == "article":
        return not OF_OTHERS.intersection(node.stems)
    return node.tag in ("div", "section", "td") and bool(node.stems) and OF_BODY.issuperset(node.stems)


def _said(node: Node, wrapper: bool) -> tuple[str, ...]:
    """The stems that speak for what the element is."""
    if not node.stems or node.tag in ("html", "body", "main"):
        return ()
    if wrapper:
        return tuple(x for x in node.stems if x in OF_BODY)
    if node.tag == "article":
        return tuple(x for x in node.stems if x in OF_BODY or x in OF_OTHERS)
    if node.tag in TEXT_PARTS:
        return tuple(x for x in node.stems if x not in OF_PLACE)
    return node.stems


#: Longer attributes are read each time, so that what is remembered stays small.
REMEMBERED_CHARS = 200


def _stems(attributes: str) -> tuple[str, ...]:
    return _remembered_stems(attributes) if len(attributes) <= REMEMBERED_CHARS else _stems_in(attributes)


def _stem(word: str) -> str | None:
    """The stem that a word is, or is with an ending, or ends in."""
    for x in (word, word.rstrip("s")):
        if x in STEMS:
            return x
    starts = [x for x in STEMS if len(x) > 3 and word.startswith(x) and word[len(x) :] in ENDINGS]
    ends = [x for x in ("nav", "menu", "footer", "header", "sidebar", "banner", "comments", "breadcrumbs") if word.endswith(x)]
    return max(starts, key=len, default=None) or (ends[0].rstrip("s") if ends else None)


def _stems_in(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for name, *values in _ATTR.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop"):
            for token in "".join(values).split():
                words = _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                if not STATES.intersection(words):
                    stems = set(filter(None, map(_stem, words)))
                    # An article's own header, as post-header, is no header of the page.
                    found += stems - {"header"} if OF_ARTICLE & stems else stems
        elif name in ("hidden", "aria-hidden"):
            found.append("hidden")
    return tuple(sorted(set(found)))


_remembered_stems = lru_cache(maxsize=16384)(_stems_in)


def evidence(node: Node) -> list[str]:
    """The features of one node, as names."""
    # Of a name such as post-comments, what it holds besides the body's words says what it is.
    stems = [f"stem={s}" for s in node.stems if s not in OF_BODY and s not in PLAIN] or [
        f"stem={s}" for s in node.stems if s in OF_BODY or node.tag not in TEXT_PARTS
    ]
    if not node.chars or node.tag in INLINE or node.tag in PARTS:
        return stems
    ratio = node.linked / node.chars
    links = "none" if ratio == 0 else "few" if ratio < 0.3 else "half" if ratio < 0.7 else "most"
    length = "short" if node.chars <= 25 else "line" if node.chars <= 100 else "long"
    # By tag: short items of a menu say nothing about short paragraphs. Other tags are judged by their edges.
    kind = "list" if node.tag in ("ul", "ol", "menu") else node.tag
    if kind not in ("p", "li", "div", "section", "list"):
        return stems
    # Paragraphs come in all lengths; a container's says little, but that a division is long.
    measured = kind in ("li", "list") or (kind == "div" and length == "long")
    return [f"links={links}@{kind}", *([f"len={length}@{kind}"] if measured else []), *stems]


# ---------------------------------------------------------------------------------------------------------------
# Labelled pages: small pages whose elements are marked by the attribute y, 1 for content and 0 for boilerplate; an
# unmarked element takes its parent's label.

_HEADS = (
    '<nav y=0><ul><li><a href="/a">Home</a></li><li><a href="/b">World</a></li><li><a href="/c">Sport</a></li></ul></nav>',
    '<header y=0><a href="/">The Daily</a><nav><a href="/x">News</a> <a href="/y">Weather</a></nav></header>',
    '<div y=0 class="header masthead"><span>The Daily</span><ul class="menu"><li><a href="/a">Shop</a></li><li><a href="/b">Help</a></li></ul></div>',
    '<div y=0 id="topnav" class="navigation"><a href="/1">One</a> <a href="/2">Two</a></div><div y=0 class="breadcrumb"><a href="/">Home</a> / <a href="/n">News</a></div>',
    '<div y=0 class="banner promo">{c}</div><header y=0><h1>The Daily</h1><p>{a}</p></header>',
    '<div y=0 class="cookie-notice" role="dialog"><p>{b}</p><button>Accept</button></div><nav y=0><a href="/a">A</a></nav>',
)
_FEET = (
    "<footer y=0>&copy; example &middot; {a}</footer>",
    "<footer y=0><p>{b}</p><p>{c}</p></footer>",
    '<footer y=0><ul><li><a href="/t">Terms</a></li><li><a href="/p">Privacy</a></li></ul><p>All rights reserved.</p></footer>',
    '<div y=0 class="related-posts"><h3>More posts</h3><p>{a}</p><p>{c}</p></div><div y=0 class="post-footer"><p>{b}</p></div>',
    '<div y=0 class="post-comments"><div class="comment-body text"><p>{c}</p></div><div class="comment-content"><p>{b}</p></div></div>',
    '<div y=0 class="content-sidebar"><p>{a}</p></div><div y=0 class="article-comments"><p>{c}</p><p>{b}</p></div><div y=0 class="page-footer">{c}</div>',
    '<div y=0 class="footer copyright">All rights reserved, 2020 to today, by the makers of this site.</div>',
    '<section y=0 class="comments" id="comments"><h3>Comments</h3><div class="comment"><p>{a}</p></div><div class="comment"><p>{b}</p><p>{c}</p></div></section>',
    '<div y=0 class="comments-list"><ol><li class="comment reply"><p>{b}</p></li></ol></div><footer y=0>Contact</footer>',
    '<aside y=0 class="sidebar"><h2>Related</h2><ul><li><a href="/r1">Another text that you may like to read</a></li><li><a href="/r2">And one more</a></li></ul></aside>',
    '<div y=0 class="related widget"><h3>More</h3><p><a href="/r">{c}</a></p><p>{b}</p></div><form y=0 class="newsletter"><label>Your mail</label><input name="m"><button>Go</button></form>',
    '<form y=0 action="/s"><p>{c}</p><p>{a}</p><textarea>text</textarea></form><div y=0 class="share social"><a href="/f">Share</a></div>',
    '<div y=0 id="disqus_thread"><h3>Comments</h3><p>{c}</p><div><p>{b}</p></div></div>',
    '<div y=0 id="respond" class="comment-respond"><h4>Leave a reply</h4><label>Name</label><p>{a}</p></div><label y=0>Your mail</label>',
    '<section y=0 id="disqus-comments"><h2>Discussion</h2><article class="comment"><header>{c}</header><p>{b}</p><article class="comment reply"><p>{a}</p></article></article></section>',
    '<footer y=0><table><tr><td><a href="/t">Terms</a></td><td><a href="/i">Imprint</a></td></tr></table><address>{c}</address><dl><dt>Mail</dt><dd>{a}</dd></dl></footer>',
    '<div y=0 class="responses"><div><p>{c}</p></div><p>{b}</p></div><div y=0 class="user-reviews"><p>{a}</p></div>',
    '<div y=0 id="reader-opinions"><p>{c}</p><p>{a}</p></div><section y=0 class="feedback"><p>{b}</p></section>',
    '<div y=0 class="conversation"><ul><li><p>{c}</p></li><li>{b}</li></ul></div><div y=0 class="talkback guestbook"><p>{c}</p></div>',
    '<div y=0 class="taboola"><p>{a}</p><a href="/z">{c}</a></div><div y=0 class="outbrain"><p>{b}</p></div>',
    "<footer y=0><ul><li>{c}</li><li>{a}</li></ul><div><p>{b}</p></div></footer>",
    '<div y=0 id="foot" class="footer"><ul><li>{a}</li><li>{c}</li></ul><span>{c}</span></div>',
    '<div y=0 class="comments remarks"><h5>Remarks</h5><ul><li><p>{c}</p><ul><li><p>{b}</p></li></ul></li></ul></div>',
)
_EXTRAS = (
    '<div y=0 class="ad">{a}</div>',
    '<div y=0 class="advert sponsor"><p>{b}</p><a href="/ad">See more</a></div>',
    '<div y=0 class="notice alert"><p>{c}</p></div>',
    '<aside y=0><p>{a}</p><p>{b}</p></aside>',
    '<div y=0 id="sidebar" class="side"><p>{b}</p><ul><li><a href="/q">Q</a></li></ul></div>',
    '<div y=0 class="content-ad">{b}</div><div y=0 class="main-menu"><ul><li>{c}</li></ul></div>',
    '<div y=0 class="adsbygoogle">{a}</div><div y=0 class="gdpr overlay"><p>{c}</p></div><div y=0 class="paywall interstitial"><p>{b}</p></div>',
    '<div y=0 class="popup modal subscribe"><h2>Do not miss a thing</h2><p>{c}</p></div>',
    "",
)
_TEXTS = (
    "Rain fell over the hills all night, and by the morning the river had risen above the lower fields.",
    "The council met again on Monday. It heard from nine people who live close to the road, and from two who do not.",
    "Yes.",
    "On page two.",
    "Four words and more.",
    "A line of a middling length, as most lines are.",
    "Nobody could say, at first, what the letters meant; a second box of them was found later in the same house, under the stairs, and with it a key.",
    "Short words.",
)
_BODIES = (
    '<article y=1 class="{k}"><h1>{h}</h1><p>{a}</p><p>{b}</p><p>{c}</p></article>',
    "<article y=1><h1>{h}</h1><p><b>{h} {a}<br><p>{b}</p><p>{c}</article>",
    '<main y=1><h2>{h}</h2><p>{a} <a href="/in">{c}</a> {b}</p><ul><li>{b}</li><li>{c}</li></ul></main>',
    '<div y=1 class="{k}"><h1 class="title">{h}</h1><div class="entry"><p>{a}</p><blockquote><p>{b}</p></blockquote></div></div>',
    '<div y=1 id="{k}" class="post"><h1>{h}</h1><div>{a}</div><div>{b}</div><pre>{c}</pre></div>',
    "<section y=1 id={k}><h1>{h}</h1><p>{a}</p><h2>{c}</h2><p>{b}</p><table><tr><td>{a}</td><td>{c}</td></tr></table></section>",
    '<div y=1 class="{k} text"><p class="lead">{a}</p><figure><figcaption class="caption">{c}</figcaption></figure><p>{b}</p></div>',
    "<h1 y=1>{h}</h1><p y=1>{a}</p><p y=1>{b}</p><div y=1>{c}</div>",
    '<article y=1><h1>{h}</h1><p><a href="/l">{a}</a></p><ul><li><a href="/m">{c}</a></li><li><a href="/n">{h}</a></li></ul><section><h3>{c}</h3><p>{b}</p></section></article>',
    "<div y=1 class='{k}'><div>{a}</div><div>{b} <span>{c}</span></div><div><p>{c}</p><p><i>{a}</i></p></div></div>",
    "<article y=1><h1>{h}</h1><p>{c}</p></article>",
    "<article y=1><h1>{h}</h1>" + "<p>Yes.</p><p>{c}</p><p>Or so.</p>" * 8 + "</article>",
    '<article y=1><h1>{h}</h1><p>Here:</p><p><a href="/l">{c}</a></p><p><a href="/k">{a}</a></p><p><a href="/m">{b}</a></p></article>',
    '<div y=1 id="{k}"><h1>{h}</h1><p>{a}</p><p>{c}</p><ul><li>{c}</li><li>{b}</li></ul></div>',
    '<div y=1 class="{k}"><div class="inner"><h2>{h}</h2><div>{a}</div><div>{c}</div></div></div>',
    "<div y=1><h1>{h}</h1><div><div>{a}</div><div>{b}</div></div></div>",
    '<div y=1 id="{k}"><div class="text"><p>{b}</p><p>{c}</p></div><div><p>{a}</p></div></div>',
    '<div y=1><div class="{k}"><p>{c}</p><p>{a}</p></div></div>',
    '<article y=1><h1>{h}</h1><div class="text"><p>{c}</p><div>{b}</div></div></article>',
    "<main y=1><p>No.</p>" + "<p>{c}</p><p>On.</p>" * 6 + "<p>{a}</p></main>",
    '<main y=1><article id="{k}"><h1>{h}</h1><ol><li>{a}</li><li>{c}</li></ol><h3>{c}</h3><dl><dt>{c}</dt><dd>{b}</dd></dl>{x}<p>{a}</p></article></main>',
    '<main y=1><article><div class="text"><header><h1>{h}</h1><p>{c}</p></header><p>{a}</p><p>{b}</p></div></article></main>',
    '<article y=1><header><h1>{h}</h1></header><p>{a}</p>{x}<p>{b}</p><p>{c}</p><footer y=0><a href="/tag">tags</a></footer></article>',
    "<article y=1><h2>{h}</h2><table><thead><tr><th>Year</th><th>Sum</th></tr></thead><tbody>" + "<tr><td>1990</td><td>{c}</td></tr>" * 7 + "</tbody></table><p>{a}</p></article>",
    "<article y=1><h1>{h}</h1><p>{b}</p><table>" + "<tr><th>Part</th><td>12</td><td>3.4</td></tr>" * 9 + "</table>{x}<p>{a}</p></article>",
    "<main y=1><h1>{h}</h1><p>{a}</p><dl><dt>One</dt><dd>{c}</dd><dt>Two</dt><dd>2</dd></dl><address>{c}</address></main>",
    "<article y=1><h1>{h}</h1><h4>{c}</h4><p>{a}</p><h5>Next</h5><p>{c}</p><h6>Last</h6><p>{b}</p></article>",
    '<div y=1 class="{k}"><h1>{h}</h1><details><summary>More</summary><p>{a}</p></details><blockquote>{c}</blockquote><pre><code>x = 1\ny = 2</code></pre></div>',
    "<article y=1><pre>{c}</pre></article>",
    "<article y=1><pre><code>for x in y:\n  print(x)</code></pre></article>",
    "<article y=1><h1>{h}</h1><p>{c}</p><figure><table><caption>{c}</caption><tr><td>1</td><td>2</td></tr></table><figcaption>Fig. 1</figcaption></figure><p>{b}</p></article>",
    "<main y=1><section><h4>{c}</h4><ul><li>One</li><li>Two</li><li>Three</li></ul></section><section><h4>{h}</h4><ol><li>No</li><li>Yes</li></ol></section></main>",
    "<article y=1><p>{c}</p></article>",
    "<article y=1><p>{a}</p>" + "<div>Yes.</div><p>{c}</p><div>On <b>page</b> two.</div>" * 6 + "<div>{b}</div><div>So.</div></article>",
    '<div y=1 class="{k}">' + "<div>{c}</div><div>No.</div><div><div>Or.</div>{a}</div>" * 6 + "<section><div>{c}</div><div>Two.</div></section></div>",
    "<main y=1>" + "<div><div>{c}</div><p>{a}</p><div>Three.</div></div>" * 5 + "</main>",
    '<article y=1><h1>{h}</h1><p>{c}</p><ul><li><a href="/m">{c}</a></li><li><a href="/n">{a}</a></li><li><a href="/o">{h}</a></li></ul><p>{b}</p></article>',
    '<div y=1 class="{k}"><h3>{h}</h3><p>{a}</p><h4>{c}</h4><ul><li>{c}</li><li>Four</li></ul><center>{c}</center><p>{b}</p></div>',
)


_NAMES = ("content", "main", "article", "post-content", "article-body", "entry", "story", "page-content", "main-content", "post", "entry-content", "text")


def labelled_pages(bodies: tuple[str, ...] = _BODIES, feet: tuple[str, ...] = _FEET) -> Iterator[str]:
    """Marked pages: heads, bodies, extras and feet in all turns, inside the wrappers that pages use."""
    shells = (
        "<html y=1><head y=0><title>{h}</title><style>p{{}}</style><script>var a=1;</script></head><body>{top}{ad}{body}{foot}</body></html>",
        '<html y=1><head y=0><title>{h}</title></head><body><div class="wrapper container">{top}<div class="row">{body}{ad}</div>{foot}</div></body></html>',
        '<html y=1><body><div id="page"><div class="inner"><div><div>{top}{ad}<div><div>{body}</div></div></div></div></div></div>{foot}<script y=0>track();</script></body></html>',
    )
    n = 0
    for body in bodies:
        for k, top in enumerate(_HEADS):
            for j, foot in enumerate(feet):
                texts = [_TEXTS[(n + i * (k + 1) + j) % len(_TEXTS)] for i in range(4)]
                words = {"h": texts[3][:60], "a": texts[0], "b": texts[1], "c": texts[2]}
                other = dict(zip("habc", (texts[1], texts[2], texts[3], texts[0]), strict=True))
                extra = _EXTRAS[(n + j) % len(_EXTRAS)].format(**other)
                filled = body.format(**words, k=_NAMES[n % len(_NAMES)], x=_EXTRAS[n % len(_EXTRAS)].format(**other))
                yield shells[n % len(shells)].format(h=texts[3][:40], top=top.format(**other), ad=extra, body=filled, foot=foot.format(**other))
                n += 1


_MARK = re.compile(r"\by=([01])")
#: What HTML puts outside the text is content with this probability, which no evidence below it outweighs.
NEVER = 1e-60
#: Items that speak for a list; more of them say no more.
ITEMS = 4
#: A tag that no labelled page has takes its parent's state, but for this share.
INHERIT = 0.02


def _edge(nodes: list[Node], k: int) -> tuple[str, str]:
    """What the potential between a node and its parent goes by: both tags, and whether attributes name the node, and as part of a text or not."""
    return nodes[nodes[k].parent].tag, _named(nodes[k])


def _named(node: Node) -> str:
    # A header inside an article is not the page's.
    tag = f"{node.tag}^" if node.inside and node.tag in ("header", "footer", "nav") else node.tag
    if not node.stems:
        return tag
    return f"{tag}+" if all(x in OF_BODY or x in PLAIN for x in node.stems) else f"{tag}#"


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, float], dict, float]:
    """(log evidence ratios by feature, P(content | parent's state) by edge, the root's prior), from labelled pages.

    A feature's ratio is of its smoothed shares among content and boilerplate nodes of its kind, as what a tag says is in
    the edges. An edge leans on its child's tag, which leans on inheritance, each as if four more nodes had been seen.
    """
    return learnt(labelled_pages())


def _kind(feature: str) -> str:
    """The kind of nodes among which a feature's shares are taken; for paragraphs all, as their number speaks too."""
    kind = feature.partition("@")[2]
    return "" if kind == "p" else kind


def learnt(pages: Iterator[str]) -> tuple[dict[str, float], dict, float]:
    """The potentials that marked pages give; see ``trained``."""
    counts: dict[str, list[float]] = {}
    edges: dict = {}
    totals: dict[str, list[float]] = {}
    seen = 0
    for page in pages:
        nodes, marks = _marked(page)
        seen += 1
        labels = [1]
        for k in range(1, len(nodes)):
            up = labels[nodes[k].parent]
            mine = up if marks[k] is None else marks[k]
            labels.append(mine)
            for name in (_edge(nodes, k), _named(nodes[k])):
                edges.setdefault(name, [[0.0, 0.0], [0.0, 0.0]])[up][mine] += 1
            names = evidence(nodes[k])
            for kind in {"", *map(_kind, names)}:
                totals.setdefault(kind, [0.0, 0.0])[mine] += 1
            for name in names:
                counts.setdefault(name, [0.0, 0.0])[mine] += 1
    ratios = {}
    for f, c in counts.items():
        t = totals[_kind(f)]
        ratios[f] = math.log((c[1] + 2) / (t[1] + 4)) - math.log((c[0] + 2) / (t[0] + 4))
    moves: dict = {"*": (INHERIT, 1 - INHERIT)}
    for name, c in sorted(edges.items(), key=lambda e: isinstance(e[0], tuple)):
        lean = moves[name[1] if isinstance(name, tuple) else "*"]
        moves[name] = tuple(min(max((c[s][1] + 4 * lean[s]) / (sum(c[s]) + 4), 2e-3), 1 - 2e-3) for s in (0, 1))
    return ratios, moves, (seen + 1) / (seen + 2)


def outside(node: Node) -> bool:
    """Whether HTML itself says that the element is not the text: a page's footer, a menu, a form that holds no article."""
    return node.tag == "nav" or (node.tag == "footer" and not node.inside) or (node.tag == "form" and not node.core)


def potential(moves: dict, nodes: list[Node], k: int) -> tuple[float, float]:
    """P(content) of node k by its parent's state; nothing of what HTML puts outside is content."""
    p0, p1 = moves.get(_edge(nodes, k)) or moves.get(_named(nodes[k])) or moves["*"]
    return (NEVER, p1) if outside(nodes[nodes[k].parent]) else (p0, p1)


def local(nodes: list[Node], k: int, ratios: dict[str, float]) -> float:
    """The logarithm of node k's own evidence for content. The items of a list count as ``ITEMS`` of them at most."""
    node = nodes[k]
    if outside(node):
        return math.log(NEVER)
    z = sum(ratios.get(f, 0.0) for f in evidence(node))
    if node.tag == "li":
        z *= min(1.0, ITEMS / nodes[node.parent].items)
    return min(max(z, -12.0), 12.0)


def _marked(page: str) -> tuple[list[Node], list[int | None]]:
    """Nodes of a labelled page and each one's mark."""
    nodes, _ = parse(page)
    marks: list[int | None] = [None]
    for m in _TOKEN.finditer(page):
        if m[2] and m[2].lower() not in VOID:
            found = _MARK.search(m[3])
            marks.append(int(found[1]) if found else None)
    assert len(marks) == len(nodes)
    return nodes, marks


def marginals(nodes: list[Node], model: tuple | None = None) -> list[float]:
    """P(content) of each node, by sum-product: messages upward in reverse page order, then downward in page order."""
    ratios, moves, prior = model or trained()
    n = len(nodes)
    own = [(1.0, 1.0)] * n
    for k in range(1, n):
        z = local(nodes, k, ratios)
        own[k] = (1.0, math.exp(z)) if z < 0 else (math.exp(-z), 1.0)
    below = [list(x) for x in own]  # evidence at and under a node, by its state
    message: list[tuple[float, float]] = [(1.0, 1.0)] * n  # to the parent, by the parent's state
    for k in range(n - 1, 0, -1):
        b0, b1 = below[k]
        top = b0 + b1
        b0, b1 = b0 / top, b1 / top
        p0, p1 = potential(moves, nodes, k)
        m0, m1 = b0 * (1 - p0) + b1 * p0, b0 * (1 - p1) + b1 * p1
        message[k] = (m0, m1)
        up = below[nodes[k].parent]
        up[0] *= m0
        up[1] *= m1
        if up[0] + up[1] < 1e-200:
            up[0], up[1] = up[0] * 1e200, up[1] * 1e200
    belief = [(0.0, 1.0)] * n
    r0, r1 = below[0][0] * (1 - prior), below[0][1] * prior
    belief[0] = (r0 / (r0 + r1), r1 / (r0 + r1))
    for k in range(1, n):
        up, (m0, m1) = belief[nodes[k].parent], message[k]
        c0, c1 = up[0] / m0, up[1] / m1  # what the parent knows without this child
        p0, p1 = potential(moves, nodes, k)
        b0, b1 = below[k]
        b0, b1 = b0 * (c0 * (1 - p0) + c1 * (1 - p1)), b1 * (c0 * p0 + c1 * p1)
        belief[k] = (b0 / (b0 + b1), b1 / (b0 + b1))
    return [b[1] for b in belief]


def extract(page: str | None, model: tuple | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    nodes, runs = parse(page)
    content = marginals(nodes, model)
    holder = list(range(len(nodes)))  # inline elements belong to the element that holds them
    seen = [True] * len(nodes)
    for k in range(1, len(nodes)):
        node = nodes[k]
        seen[k] = seen[node.parent] and node.tag not in UNSEEN
        if node.tag in INLINE:
            holder[k] = holder[node.parent]
    blocks: list[str] = []
    parts: list[str] = []
    for k, text in runs:
        if text is None:
            if parts:
                blocks.append("".join(parts))
                parts = []
        elif seen[k] and content[holder[k]] >= 0.5:
            parts.append(text)
    blocks.append("".join(parts))
    tidy = (" ".join(html_lib.unescape(b).split()) for b in blocks)
    return "\n".join(b for b in tidy if b)


def main_text(html: Column) -> Column:
    """The main text of a column of pages, in Arrow batches; tasks get the potentials, a few hundred numbers, with their code."""
    model = trained()

    @F.pandas_udf(T.StringType())
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(p, model) for p in pages], dtype="object")

    return extracted(html)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages``, all columns, with ``text_col``; a name in use gets underscores in front."""
    return pages.withColumn(free_name(pages, text_col), main_text(F.col(html_col)))
