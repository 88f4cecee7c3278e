"""Operator 2: main text of HTML pages by a minimum cut between content and boilerplate."""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.common import table

#: Elements whose text is never shown.
HIDDEN = frozenset("script style noscript template head title svg math iframe object select textarea".split())
#: Elements that don't end a block of text; all others do.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold other blocks: they stay on the stack, and blocks below the same one are near.
HOLDERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header html main menu nav ol section table tbody td tfoot th thead tr ul".split())
#: What an element's mark costs for each block below it: as content, and as boilerplate.
AGAINST = {"nav": 12, "footer": 12, "aside": 12, "menu": 12, "button": 12, "dialog": 12, "header": 8}
FOR = {"article": 6, "main": 4}
#: The same for what its names say, or an attribute that hides it. A word of BAD_WORDS weighs less than an article
#: with its sentences (6 and about 2), so that an article outweighs one word around it, and more than a paragraph
#: in an element of GOOD_WORDS (3 and at most 3).
HARD, SOFT, GOOD = 12, 7, 3
#: What a weak mark costs once, however many blocks are below it: one paragraph (at most 3) doesn't outweigh it, two do.
WEAK = 3.2
#: Elements and words that hold an article about as often as not: a page's one form, a builder's widget.
WEAK_ELEMENTS = frozenset("form fieldset".split())
WEAK_WORDS = frozenset("alert form search tags widget widgets".split())
#: Words of a class, id or role that speak against or for content.
BAD_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs complementary consent cookie cookies copyright disclaimer dropdown footer form gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices overlay pager pagination paywall popup recommended respond rail search share sharing sidebar signup sitemap skip social subscribe subscription tags toast toolbar "
    "topbar topnav trending widget widgets".split()
)
#: The like for what holds articles of its own: comments, teasers and adverts.
BAD_ARTICLES = frozenset("advert advertisement comment commentlist comments discussion disqus promo promoted promotion related replies reply sponsor sponsored teaser teasers".split())
GOOD_WORDS = frozenset("article body content entry main post story text".split())
#: Of these, what an article's own element may say beside a word for content.
WEAK_ARTICLES = frozenset("promo promoted promotion related sponsor sponsored teaser teasers".split())
#: Beginnings of class names that tell a page's state and not what an element holds.
_STATE = ("has-", "with-", "no-", "is-", "js-")
#: A tag ends at its `>`, or where the next `<` outside quotes begins another.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<))|<[!?][^<>]*+(?:>|(?=<))", re.S)
#: What an inline element's tag holds if it may be hidden.
_MAY_HIDE = re.compile("hidden|none", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_UNSEEN = re.compile(r"(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)(?![\w-])", re.I)


def attributes_of(tag: str) -> dict[str, str]:
    """A tag's attributes by lower-case name, empty where there is no value; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), "".join(values))
    return out


def names_of(attributes: dict[str, str]) -> list[str]:
    """An element's classes, id and role."""
    return [name for key in ("class", "id", "role") for name in attributes.get(key, "").split()]


def naming(names: list[str]) -> set[str]:
    """The words of names: the parts of each name, and each two parts in a row joined, so that side-bar
    and leftSideBar are sidebar as well."""
    out: set[str] = set()
    for name in names:
        if not name.lower().startswith(_STATE):
            parts = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
            parts = parts[: next((k for k, w in enumerate(parts) if w in ("with", "without")), len(parts))]
            if "free" in parts:  # alert-free
                parts = parts[parts.index("free") + 1 :]
            out.update(parts)
            out.update(a + b for a, b in zip(parts, parts[1:], strict=False))
    return out


def unseen(attributes: dict[str, str], names: list[str]) -> bool:
    """Whether an element isn't shown: the attribute hidden, aria-hidden that is true, a style that says so,
    or a name that is hidden as a whole. overflow:hidden and hidden-xs don't hide it."""
    return (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").strip().lower() == "true"
        or bool(_UNSEEN.search(attributes.get("style", "")))
        or any(name.lower() == "hidden" for name in names)
    )


def marked(name: str, tag: str, in_article: bool) -> tuple[float, set[str]]:
    """(what an element's names or style cost it as content: HARD, SOFT, WEAK or 0; the words of its names). An
    article's own head (post-header, or a header inside an article) costs nothing."""
    attributes = attributes_of(tag) if tag else {}
    names = names_of(attributes)
    words = naming(names)
    if name in ("html", "body", "main"):
        return 0, words
    if name != "article" and unseen(attributes, names):
        return HARD, words
    if worst := words & BAD_ARTICLES:
        return WEAK if name == "article" and words & GOOD_WORDS and worst <= WEAK_ARTICLES else HARD, words
    bad = set() if name == "article" else words & BAD_WORDS
    if in_article or words & GOOD_WORDS:
        bad = bad - {"header"}
    return (WEAK if bad <= WEAK_WORDS else SOFT) if bad else 0, words


_CUT_OFF = re.compile("<[a-zA-Z/!]")


class Block(NamedTuple):
    text: str
    links: int  # characters inside links
    own: float  # what the names of its own element cost as content
    article: bool  # in an article and in nothing marked as boilerplate
    holder: int  # number of the innermost holding element
    tag: str
    region: int  # place of the innermost marked element, -1 if none


class Region(NamedTuple):
    """A marked element, with what it costs for each block below it, or once where the mark is weak."""

    against: float
    favour: float
    tie: float  # to the region around it
    around: int  # that region, always an earlier one, or -1 where nothing ties it


class _Open(NamedTuple):
    tag: str
    number: int
    against: float  # the most that an element around it, or its own, costs as content
    favour: float
    region: int


def blocks(html: str) -> tuple[list[Block], list[Region]]:
    """The text blocks of a page in its order, and its marked elements. Tags may be unclosed, and the page may
    end anywhere."""
    out: list[Block] = []
    regions: list[Region] = []
    stack = [_Open("", 0, 0.0, 0.0, -1)]
    parts: list[str] = []
    count, linked, in_link, tag_now, own = 0, 0, False, "", 0.0
    opened: Counter[str] = Counter()  # elements of each name on the stack
    unclosed: set[str] = set()  # elements with no end tag further on
    veil, veiled = "", 0  # an inline element that isn't shown, and how many of its name are open

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, min(linked, len(text)), own, top.favour >= FOR["article"] and not top.against and not own, top.number, tag_now, top.region))
            parts, linked = [], 0

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        upto = m.start() if m else end
        if upto > at:
            piece = html[at:upto]
            if not m and (cut := _CUT_OFF.search(piece, piece.rfind(">") + 1)):  # a tag that the page's end cuts off
                piece = piece[: cut.start()]
            if not veil:
                parts.append(piece)
                if in_link:
                    linked += len(piece)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if veil and name in INLINE:
            if name == veil:
                veiled += -1 if m[1] else 1
                veil = veil if veiled else ""
            continue
        veil = ""
        if name in INLINE:
            if not m[1] and name not in VOID and _MAY_HIDE.search(m[3]):
                attributes = attributes_of(m[3])
                if unseen(attributes, names_of(attributes)):
                    veil, veiled = name, 1
                    continue
            if name == "a":
                in_link = not m[1]
            elif name == "br":
                parts.append(" ")
            continue
        close()
        if m[1]:
            if name in HOLDERS and opened[name]:
                while True:
                    gone = stack.pop().tag
                    opened[gone] -= 1
                    if gone == name:
                        break
                in_link = False
            tag_now, own = "", 0.0
            continue
        if name in HIDDEN:
            if name not in VOID and not m[3].endswith("/"):
                gone = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b", re.I).search(html, at)
                past = html.find(">", gone.end()) + 1 if gone else 0
                if past or name != "head":
                    at = past or end
                else:
                    unclosed.add(name)
            continue
        tag_now, own = name, 0.0
        in_article = any(opened[tag] for tag in FOR)
        named, names = marked(name, m[3], in_article)
        if name not in HOLDERS:
            own = float(named)
        elif not m[3].endswith("/"):
            top = stack[-1]
            against, favour, region = top.against, top.favour, top.region
            held = WEAK if name in WEAK_ELEMENTS else AGAINST.get(name, 0)
            bad = max(named, 0 if name == "header" and in_article else held)  # an article's own head
            good = 0 if named else FOR.get(name, GOOD if names & GOOD_WORDS and not against else 0)  # a widget's content is no article's
            if name == "main":  # the page's one main part, whatever lies around it
                against, region = 0.0, -1
            if bad or good or name == "main":
                regions.append(Region(bad, 0.0 if bad else max(favour, good), against, region if against else -1))
                region = len(regions) - 1
            count += 1
            stack.append(_Open(name, count, max(against, bad), max(favour, good), region))
            opened[name] += 1
            in_link = False
    close()
    return out, regions


def _ends_sentence(text: str) -> bool:
    """Whether a full stop or the like stands after the last word."""
    return any(c in ".!?…" for c in re.match(r"\W*+", text[::-1])[0])


def costs(b: Block) -> tuple[float, float]:
    """The classifier of a block by itself: (cost of calling it boilerplate, cost of calling it content), from its
    length, its end, its element, the share of links and its own element's names."""
    words = b.text.count(" ") + 1
    keep = min(2.0, words / 15) + (0.5 if _ends_sentence(b.text) else 0) + (0.5 if b.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote") else 0)
    share = b.links / max(1, len(b.text))
    drop = b.own + 4 * share * share * (0.25 if b.article else 1) + (0.8 if words < 4 and b.tag != "p" else 0.5 if words < 4 else 0) + (2 if re.search(r"©|\(c\)|copyright|all rights reserved", b.text, re.I) and words < 30 else 0)
    return keep, drop


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours: 0.3 next to each other, 0.7 more below the same element, and 0.5 to
    the block before last of the same element. A block that its own names mark has none."""
    out = []
    for j in range(1, len(bs)):
        for back, near in ((1, 1.0), (2, 0.5)):
            i = j - back
            if i < 0 or bs[i].own or bs[j].own:
                continue
            if bs[i].holder == bs[j].holder:
                out.append((i, j, near))
            elif back == 1:
                out.append((i, j, 0.3))
    return out


def graph(bs: list[Block], regions: list[Region]) -> tuple[list[float], list[float], list[tuple[int, int, float]]]:
    """(source, sink, links) of the cut: a node for each block, and after these one for each marked element.

    A block has the classifier's costs. A marked element has its mark's cost once for each block below it, a weak
    one once in all, so that the prose below it is weighed as a whole against what its name says. It is
    joined to the blocks whose innermost marked element it is, each at the mark's cost, and inside boilerplate to
    the marked element around it, at that one's cost for each block below; so a mark reaches a block only by
    the page's tree, and what many blocks say can outweigh it.
    """
    priced = [costs(b) for b in bs]
    links = edges(bs)
    below = [0] * len(regions)
    for i, b in enumerate(bs):
        if b.region >= 0:
            below[b.region] += 1
            links.append((i, len(bs) + b.region, max(regions[b.region][:3])))
    for r in range(len(regions) - 1, -1, -1):
        around = regions[r].around
        if around >= 0 and below[r]:
            below[around] += below[r]
            links.append((len(bs) + r, len(bs) + around, regions[r].tie * below[r]))
    source = [k for k, _ in priced] + [r.favour * n for r, n in zip(regions, below, strict=True)]
    sink = [d for _, d in priced] + [r.against * (min(n, 1) if r.against == WEAK else n) for r, n in zip(regions, below, strict=True)]
    return source, sink, links


def min_cut(source: list[float], sink: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    source[i] and sink[i] are terminal capacities, links (i, j, capacity both ways). Flow that goes straight
    through a node is taken out first; the rest is augmented along shortest paths, a level graph at a time.
    """
    n = len(source)
    rest = [a - b for a, b in zip(source, sink, strict=True)]
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for i, j, c in links:
        graph[i].append(len(to))
        to.append(j)
        room.append(c)
        graph[j].append(len(to))
        to.append(i)
        room.append(c)
    tiny = 1e-12
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if rest[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            for e in graph[i]:
                j = to[e]
                if room[e] > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    reached = reached or rest[j] < -tiny
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        nxt = [0] * n
        for s in range(n):
            while rest[s] > tiny and level[s] == 0:
                path, i = [], s
                while True:
                    if rest[i] < -tiny:
                        flow = min([rest[s], -rest[i], *(room[e] for e in path)])
                        rest[s] -= flow
                        rest[i] += flow
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        break
                    while nxt[i] < len(graph[i]):
                        e = graph[i][nxt[i]]
                        if room[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        nxt[i] += 1
                    if nxt[i] < len(graph[i]):
                        path.append(graph[i][nxt[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        nxt[i] += 1
                    else:
                        break
                else:
                    continue
                if not path and not rest[s] > tiny or nxt[s] >= len(graph[s]):
                    break


def main_text(html: str | None) -> str:
    """The article's text: content blocks of the minimum cut, in page order, joined by a space."""
    found, regions = blocks(html or "")
    if not found:
        return ""
    keep = min_cut(*graph(found, regions))
    return " ".join(b.text for b, k in zip(found, keep, strict=False) if k)


def extract(pages: DataFrame) -> DataFrame:
    """pages (html, others) with text: the main text of the whole page, and n_chars: its code points.

    Null and empty pages give an empty text; ties go to boilerplate; repeated rows each get their text; an
    empty table gives no rows. Reading a very long page takes time in proportion to it, whatever is nested,
    unclosed or cut off. Columns of pages named text or n_chars are replaced.
    """

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(h) for h in html], dtype=object)

    return pages.withColumn("text", text(F.col("html"))).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
