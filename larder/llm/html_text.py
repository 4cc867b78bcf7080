"""Main text of web pages by tag-path ratios.

A page is read once, as a stream of tags and text. Text gathers in blocks (paragraphs, headings,
list items, cells, ...); each block belongs to the path of tags from the root to it. Per path, the
text length, punctuation and link text of its blocks are summed; both ratios to the number of
blocks are smoothed with those of the path's parent, fused into one score and held against a
threshold relative to the page's best path. The blocks of the paths above it are the content
nodes. The smallest element that holds nearly all of their text, or the marked one, bounds the article.
Inside it content nodes are taken, and of the blocks below the threshold those that join them:
* inside a marked article, a block whose path doesn't look like boilerplate (most of its text in links, or short blocks, three or more,
  that don't read like sentences): leads, closing lines and standfirsts are shorter than the body, and no less the article;
* a block with less than half its text in links, if it lies between two content nodes or if its container
  (what is above it, lists, tables, quotes and figures passed over) is one that content nodes have: by
  path for paragraphs, items and cells, the very element for bare text;
* a heading with a taken block behind it, before the next heading of its own or a higher level, or
  directly followed by a heading that is taken; the last heading of a marked article with nothing behind it.
Link lists are never taken, but for lists of a marked article whose items read like sentences (references), nor are lines of the
article's header but for headings, content paths and sentences (a standfirst).

Elements that are never the article (menus, page headers and footers, asides, scripts, styles, hidden
elements) are known by tag or role, and don't enter the sums. Words of class and id (sidebar, notice,
advert, comments, ...) and forms only make an element suspect: it is left out unless it holds the
page's only marked article or more than half of the text that competes, as a wrapper of the page does; then its paths
compete like others. Words that are common otherwise count among words of layout only (share-buttons, but not
hidden-gem). Comments, adverts and links to related pages can be longer than the article, so these are let in only where
nothing else is left. Words behind has, no, with or without say nothing (has-sidebar). Where a page marks
its article (article, main, role or itemprop), only paths inside the mark compete.

Pages don't depend on one another: no shuffle, and memory is that of a small batch of pages. A page is read
in linear time, however broken; elements more than DEPTH deep have the path of the one they are in, and are boilerplate by the same rules.

Defined cases: null or empty html, or html without text, gives an empty text; unclosed tags,
quotes and comments end with the page; very long pages are read whole; equal rows are treated
alike; extra columns ride along, columns with the result's names are replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larder.llm.common import appended, small_batches, with_fields

#: Share of the best path's score that a content path reaches; share of the content that the article holds.
THRESHOLD, HELD = 0.2, 0.9
#: Weight of the path itself against its parent in smoothing.
OWN_WEIGHT = 0.7

#: A tag without angle brackets inside. It ends at the next one at the latest, so reading a page stays linear.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?>(?:[^<>"']|"[^"<>]*"|'[^'<>]*')*))>""")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOPS = re.compile("[>\"']")
#: Elements inside elements whose paths are told apart; those further inside have the innermost one's path.
DEPTH = 100
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?。、，！？]")
SENTENCE = re.compile(r"[.,;:!?](?:[\s)\"'”’»\]]|$)")
#: Inside a marked article: blocks of a path from which on it is a repetition, and their length below which they are short.
REPEATED, SHORT = 3, 60

RAW = frozenset("script style textarea title noscript template iframe noframes xmp svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr
    math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover semantics annotation""".split()
)
NEVER = frozenset("nav footer aside button select menu dialog head".split())
#: Words of class and id, whole words only, of what is mostly no part of an article.
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
    sidebar aside footer masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social
    related recommended comment comments disqus reply replies widget pagination pager toolbar skip hidden""".split()
)
#: Those that are common words as well: they count where all words of the name are of layout.
COMMON = frozenset("promotion navigation menu notice notices alert overlay share sharing social related recommended reply replies skip hidden banner".split())
LAYOUT = frozenset(
    """area bar block body bottom box button buttons center col column container content footer form group head header icon icons inner item items js left links
    list main message modal module page panel policy post posts right row section site slot stories story text title top unit wrap wrapper articles article box""".split()
)
#: Those of what can be long by itself; words that say of the word behind that it is about the layout.
APART = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo related recommended comment comments disqus reply replies".split())
NEUTRAL = frozenset(("has", "no", "with", "without"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
MARKS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog".split())
#: What a start tag closes when it is open.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LEAVES = HEADINGS | {"p", "li", "dt", "dd", "td", "th", "tr", "blockquote", "pre", "figcaption", "caption", "summary"}
LISTS = frozenset(("ul", "ol", "dl", "table"))
#: What doesn't count as a container of its own.
PASSED = LISTS | LEAVES | {"thead", "tbody", "tfoot", "figure", "details", "header", "hgroup"}


class _Block:
    __slots__ = ("path", "chain", "text", "links", "marked", "header", "around", "inside")

    def __init__(self, path, chain, text, links, marked, header, around=(), inside=()):
        self.path, self.chain, self.text, self.links, self.marked, self.header = path, chain, text, links, marked, header
        # Numbers of the suspect elements it is in: those around the mark, or the mark itself, and those inside it or without one.
        self.around, self.inside = around, inside


#: Degrees of doubt about an element.
SUSPECT, SET_APART, NO = 1, 2, 3


def _names(value: str) -> set[str]:
    """The words of a class or id, small, without those behind a neutral word, and common words only among words of layout."""
    out: set[str] = set()
    for name in value.split():
        words: list[str] = []
        for w in WORDS.findall(name):
            if (w := w.lower()) in NEUTRAL:
                break
            words.append(w)
        plain = all(w in BOILERPLATE or w in LAYOUT for w in words)
        out.update(w for w in words if plain or w not in COMMON)
    return out


def _doubt(tag: str, attributes: str, in_article: bool) -> int:
    """NO for what is never part of an article, SUSPECT or SET_APART for what mostly isn't, else 0."""
    if tag in NEVER or tag == "header" and not in_article:
        return NO
    doubt = SUSPECT if tag == "form" else 0
    if "=" not in attributes and "hidden" not in attributes:
        return doubt
    if re.search(r"(?:^|\s)hidden(?:\s|$|=)", attributes):
        return NO
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name in ("class", "id"):
            if tag in ("html", "body"):
                continue
            words = _names(value)
            if tag in ("main", "article"):
                if not words.isdisjoint(("comment", "comments", "ad", "ads", "advert", "related")):
                    doubt = SET_APART
            elif not words.isdisjoint(BOILERPLATE):
                doubt = max(doubt, SUSPECT if words.isdisjoint(APART) else SET_APART)
        elif name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return NO
        elif name == "role" and value.lower() == "form":
            doubt = max(doubt, SUSPECT)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return NO
    return doubt


def _is_mark(tag: str, attributes: str) -> bool:
    return tag in MARKS or bool(attributes) and bool(re.search(r"""role\s*=\s*["']?main\b|itemprop\s*=\s*["']?articleBody\b""", attributes))


class _Tags:
    """The tags of a page from a place on, each with the place behind it, in time linear in the page.

    A tag ends at the first > outside of quotes or, if quotes are left open, at the first > at all; without one
    it is text, but for a last one that the page breaks off in. Where the ends of quotes have been looked for is remembered, so no part of a page is read again.
    """

    def __init__(self, page: str):
        self.page, self.n, self.last = page, len(page), page.rfind(">")
        self.cdata = page.rfind("]]>")
        self.ends: dict[int, int] = {}
        self.seen = (0, -1)

    def _stop(self, at: int) -> int:
        """The next > or quote."""
        low, high = self.seen
        if not low <= at <= high:
            m = STOPS.search(self.page, at)
            self.seen = (at, m.start() if m else self.n)
        return self.seen[1]

    def _end(self, at: int) -> int:
        """The first > outside of quotes, or -1."""
        way: list[int] = []
        found = -1
        while (stop := self._stop(at)) < self.n:
            if stop in self.ends:
                found = self.ends[stop]
                break
            if self.page[stop] == ">":
                found = stop
                break
            way.append(stop)
            close = self.page.find(self.page[stop], stop + 1)
            if close < 0:
                break
            at = close + 1
        for w in way:
            self.ends[w] = found
        return found

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """Start and end of the next piece of markup, and if it is a tag its slash, name and attributes."""
        page = self.page
        while 0 <= (start := page.find("<", at)):
            m = TAG.match(page, start)
            if m:
                return start, m.end(), m[1], m[2], m[3]
            after = page[start + 1 : start + 2]
            if after in ("!", "?"):
                if page.startswith("<!--", start):
                    end = page.find("-->", start + 4)
                    return start, end + 3 if end >= 0 else self.n, "", "", ""
                if page.startswith("<![CDATA[", start) and start < self.cdata:
                    return start, page.find("]]>", start) + 3, "", "", ""
                end = page.find(">", start) if start < self.last else -1
                return start, end + 1 if end >= 0 else self.n, "", "", ""
            m = NAME.match(page, start) if start < self.last and (after == "/" or after.isalpha()) else None
            if m:
                end = self._end(m.end())
                if end < 0:
                    end = page.find(">", m.end())
                return start, end + 1, m[1], m[2], page[m.end() : end]
            at = start + 1
            if (after == "/" or after.isalpha()) and page.find("<", at) < 0:
                # The page ends within a tag.
                return start, self.n, "", "", ""
        return self.n, self.n, "", "", ""


class _Element:
    """An open element: tag, number and path of the solid ones down to it, and what its blocks inherit."""

    __slots__ = ("tag", "path", "chain", "never", "marked", "header", "around", "inside")

    def __init__(self, tag, path, chain, never=False, marked=False, header=False, around=(), inside=()):
        self.tag, self.path, self.chain, self.never, self.marked, self.header, self.around, self.inside = tag, path, chain, never, marked, header, around, inside


def blocks(page: str) -> list[_Block]:
    """The page's text blocks outside boilerplate, in order."""
    out: list[_Block] = []
    stack = [_Element("", "", (0,))]
    # The elements inside the DEPTH innermost: tag, whether it is never part of an article, suspect elements it is in. How often each tag is among them.
    deep: list[tuple[str, bool, tuple[int, ...]]] = []
    deep_count: dict[str, int] = {}
    apart: set[int] = set()
    texts: list[str] = []
    links = at = count = in_link = 0
    tags, n = _Tags(page), len(page)

    def flush() -> None:
        nonlocal links
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                e = stack[-1]
                out.append(_Block(e.path, e.chain, text, links, e.marked, e.header, e.around, e.inside + deep[-1][2] if deep else e.inside))
            texts.clear()
        links = 0

    def close(i: int) -> None:
        nonlocal in_link
        in_link -= sum(e.tag == "a" for e in stack[i:])
        del stack[i:]
        deep.clear()
        deep_count.clear()

    while at < n:
        start, end, closing, tag, attributes = tags.next(at)
        if start > at and not stack[-1].never and not (deep and deep[-1][1]):
            data = page[at:start]
            if "&" in data:
                data = entities.unescape(data)
            texts.append(data)
            if in_link:
                links += len(data.strip())
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br" or tag == "wbr":
            if not stack[-1].never and not (deep and deep[-1][1]) and tag == "br":
                texts.append(" ")
            continue
        if not closing and tag in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if deep_count.get(tag):
                while (gone := deep.pop()[0]) != tag:
                    deep_count[gone] -= 1
                deep_count[tag] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE or tag == "p" and stack[i].tag in ("div", "article", "section", "td"):
                    break
            continue
        if tag in VOID:
            continue
        if tag not in INLINE and not deep:
            # A block start ends an open paragraph, and a list item, cell or term the one before it.
            for i in range(len(stack) - 1, 0, -1):
                open_tag = stack[i].tag
                if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                    close(i)
                    break
                if open_tag not in INLINE and not (tag == "tr" and open_tag in ("td", "th")):
                    break
        if len(stack) > DEPTH:
            above = deep[-1] if deep else ("", False, ())
            doubt = _doubt(tag, attributes, stack[-1].marked)
            count += 1
            suspect = doubt in (SUSPECT, SET_APART)
            if doubt == SET_APART:
                apart.add(count)
            # Below the first suspect others say nothing new, so the list of them stays short.
            deep.append((tag, above[1] or doubt == NO, above[2] + (count,) if suspect and len(above[2]) < DEPTH else above[2]))
            deep_count[tag] = deep_count.get(tag, 0) + 1
            continue
        up = stack[-1]
        marked = up.marked or _is_mark(tag, attributes)
        count += 1
        doubt = _doubt(tag, attributes, up.marked)
        around, inside = up.around, up.inside
        if marked and not up.marked:
            around, inside = around + inside, ()
        if doubt in (SUSPECT, SET_APART):
            if marked and not up.marked:
                around += (count,)
            else:
                inside += (count,)
            if doubt == SET_APART:
                apart.add(count)
        solid = tag not in INLINE
        path, chain = (f"{up.path}/{tag}", (*up.chain, count)) if solid else (up.path, up.chain)
        stack.append(_Element(tag, path, chain, up.never or doubt == NO, marked, up.header or tag == "header", around, inside))
        in_link += tag == "a"
    flush()
    return _let_in(out, apart)


def _let_in(found: list[_Block], apart: set[int]) -> list[_Block]:
    """The blocks but for those in suspect elements that are neither the way to the only mark nor most of the text."""
    if not any(b.around or b.inside for b in found):
        return found
    for allowed in (False, True):
        # Suspects around marks count only while no mark stands outside of them.
        shut = lambda elements: not allowed and not apart.isdisjoint(elements)  # noqa: B023, E731
        marked = [b for b in found if b.marked and not b.around] or [b for b in found if b.marked and not shut(b.around)]
        rest = marked or [b for b in found if not b.marked]
        held: dict[int, int] = {}
        for b in rest:
            for e in b.inside:
                held[e] = held.get(e, 0) + len(b.text)
        total = sum(len(b.text) for b in rest)
        most = {e for e, n in held.items() if 2 * n > total and not shut((e,))}
        kept = [b for b in rest if most.issuperset(b.inside)]
        if kept:
            return kept
    return []


def path_scores(found: list[_Block]) -> dict[str, float]:
    """The fused ratios of each tag path: text and punctuation per block, less link text, smoothed with the parent's."""
    sums: dict[str, list[float]] = {}
    for b in found:
        row = (1, len(b.text), len(PUNCTUATION.findall(b.text)), min(b.links, len(b.text)))
        for path in (b.path, b.path.rpartition("/")[0] + "/*"):
            if (s := sums.get(path)) is None:
                sums[path] = list(row)
            else:
                for i in range(4):
                    s[i] += row[i]
    scores = {}
    for path, (n, chars, marks, links) in sums.items():
        if path.endswith("/*"):
            continue
        pn, pchars, pmarks, _ = sums[path.rpartition("/")[0] + "/*"]
        text = OWN_WEIGHT * chars / n + (1 - OWN_WEIGHT) * pchars / pn
        punctuation = OWN_WEIGHT * marks / n + (1 - OWN_WEIGHT) * pmarks / pn
        scores[path] = text * (1 + punctuation) * (1 - links / max(1, chars)) ** 2
    return scores


def _within(found: list[_Block], nodes: list[_Block]) -> list[_Block]:
    """The blocks of the smallest element with nearly all of the content nodes' text, and the headings that lead to it."""
    held: dict[int, int] = {}
    for b in nodes:
        for e in b.chain[:-1] if b.path.rpartition("/")[2] in LEAVES else b.chain:
            held[e] = held.get(e, 0) + len(b.text)
    need = HELD * sum(len(b.text) for b in nodes)
    article = max((e for e, chars in held.items() if chars >= need), default=0)
    chain = next(b.chain for b in nodes if article in b.chain) if article else (0,)
    around = chain[max(0, chain.index(article) - 2)]
    first = next(i for i, b in enumerate(found) if article in b.chain)
    leads = [b for b in found[:first] if b.path.rpartition("/")[2] in HEADINGS and around in b.chain]
    return leads + [b for b in found if article in b.chain]


def _container(b: _Block) -> tuple[str, int]:
    """Path and number of the element above a block, without lists, tables, quotes and figures, and without a div around a list or table."""
    parts = b.path.split("/")
    if parts[-1] not in LEAVES and len(parts) > 1:
        parts.pop()
    listed = False
    while len(parts) > 1 and (parts[-1] in PASSED or listed and parts[-1] == "div"):
        listed = parts[-1] in LISTS
        parts.pop()
    return "/".join(parts), b.chain[len(parts) - 1]


def _sentence(text: str) -> bool:
    """Whether a text reads like running text: some words and a sign that ends or parts them."""
    return text.count(" ") >= 3 and bool(SENTENCE.search(text))


def _apart(inside: list[_Block]) -> set[str]:
    """Paths that look like boilerplate inside a marked article: most of their text in links, or short blocks, three or more, that
    don't read like text. A path that is only shorter than the body doesn't."""
    sums: dict[str, list[int]] = {}
    for b in inside:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(b.text), min(b.links, len(b.text)), _sentence(b.text))):
            s[i] += x
    return {p for p, (n, chars, links, sentences) in sums.items() if 2 * links >= chars and 2 * sentences < n or n >= REPEATED and chars < SHORT * n and 4 * sentences < n}


def _selected(inside: list[_Block], content: set[str], shut: list[bool]) -> list[_Block]:
    """The content nodes (blocks of the content paths) and what joins them, as the module's text states; none that is shut out."""
    tags = [b.path.rpartition("/")[2] for b in inside]
    places = [i for i, b in enumerate(inside) if b.path in content and not shut[i]]
    if not places:
        return []
    marked = inside[0].marked
    homes = {x for i in places for x in _container(inside[i])}
    apart = _apart(inside) if marked else set()

    def joins(i: int, b: _Block) -> bool:
        if marked and b.path not in apart:
            return 2 * b.links < len(b.text) or _sentence(b.text)
        if 2 * b.links >= len(b.text):
            return False
        # Bare text of a div or the like is held to the very element, a paragraph or item to the path.
        return places[0] < i < places[-1] or _container(b)[tags[i] not in LEAVES] in homes

    taken = [not shut[i] and (b.path in content or tags[i] not in HEADINGS and joins(i, b)) for i, b in enumerate(inside)]
    # Backwards: the levels of headings that the taken text behind is still without; and whether anything at all stands
    # behind in the same section, which a heading at the end of a marked article may lack.
    waiting, behind = 0, False
    for i in range(len(inside) - 1, -1, -1):
        if tags[i] in HEADINGS:
            level = int(tags[i][1])
            taken[i] = taken[i] or level <= waiting or i + 1 < len(inside) and tags[i + 1] in HEADINGS and taken[i + 1] or marked and not behind
            # Behind a heading its section ends for those of its own and lower levels.
            waiting = level - 1 if taken[i] else min(waiting, level - 1)
        elif taken[i]:
            waiting = 6
        behind = True
    return [b for b, t in zip(inside, taken, strict=True) if t]


def content_blocks(found: list[_Block]) -> list[_Block]:
    """The blocks of the article."""
    if any(b.marked for b in found):
        found = [b for b in found if b.marked]
    if not found:
        return []
    scores = path_scores(found)
    least = THRESHOLD * max(scores.values())
    nodes = [b for b in found if scores[b.path] >= least]
    inside = found if found[0].marked else _within(found, nodes)
    # Link lists: paths under a list whose text is links, several of them.
    count: dict[str, list[int]] = {}
    for b in inside:
        s = count.setdefault(b.path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(b.text), min(b.links, len(b.text)), _sentence(b.text))):
            s[i] += x
    # Items that read like text are references, not links.
    linked = {p for p, (n, chars, links, texts) in count.items() if n >= REPEATED and links >= 0.8 * chars and LISTS & set(p.split("/")) and not (found[0].marked and 2 * texts >= n)}
    content = {b.path for b in nodes}
    shut = [b.path in linked or b.header and b.path not in content and b.path.rpartition("/")[2] not in HEADINGS and not (b.marked and _sentence(b.text)) for b in inside]
    return _selected(inside, content, shut)


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in content_blocks(blocks(page or "")))


def extracted(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages and text, the article of the html column, with n_chars, its code points."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            texts = [main_text(h) for h in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield appended(b, ["text", "n_chars"], [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())])

    fields = T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())
    return pages.mapInArrow(extract, with_fields(pages.schema, *fields))
