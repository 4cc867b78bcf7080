import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import types as T

from larder.llm import html_text as H
from larder.llm import queries

BODY = "<p>First paragraph, with some words; and more of them.</p><p>Second one &amp; its text, too.</p>"
WANT = "First paragraph, with some words; and more of them.\n\nSecond one & its text, too."

PAGES = {
    "article": (f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>Head</h1>{BODY}</article><footer>&copy; x, y.</footer></body></html>", f"Head\n\n{WANT}"),
    "divs": (f'<body><div id="menu"><a>One</a></div><div class="post"><h1>Head</h1><div class="entry">{BODY}</div></div><div class="sidebar"><p>Side, text here, long enough to matter, really.</p></div></body>', f"Head\n\n{WANT}"),
    "comments": (f'<main>{BODY}</main><section id="comments"><p>{"A reader says, at length: yes. " * 20}</p></section>', WANT),
    "notice": (f'<div class="cookie-notice">We use cookies, lots of them.</div><div>{BODY}</div><form><p>Sign up, now.</p></form>', WANT),
    "advert inside": (f'<article>{BODY}<div class="ad">Buy, buy, buy.</div></article>', WANT),
    "script": (f'<script>var a="</p><p>no</p>";</script><style>p{{}}</style><article>{BODY}</article><!-- <p>no</p> -->', WANT),
    "nested inline": ("<article><p>A <b>bold <i>word</i></b>, a <a href='x'>link</a>.</p></article>", "A bold word, a link."),
    "white space": ("<article><p>a\n\t b&nbsp; c<br>d</p></article>", "a b c d"),
    "unclosed": ("<article><h1>T</h1><p><b>one.<br><p>two.</article>", "T\n\none.\n\ntwo."),
    "references": ("<p>&lt;tag&gt; &#228; &#x41; &amp;amp; &unknown; &a</p>", "<tag> ä A &amp; &unknown; &a"),
    "link list": (f"<article>{BODY}<ul><li><a>aaa</a></li><li><a>bbb</a></li><li><a>ccc</a></li></ul></article>", WANT),
    "list": ("<article><p>Intro, with text.</p><ul><li>one, two</li><li>three.</li></ul></article>", "Intro, with text.\n\none, two\n\nthree."),
    "table": ("<article><p>Text, of it.</p><table><tr><td>a</td><td>b</td></tr></table></article>", "Text, of it.\n\na\n\nb"),
    "header in article": ("<article><header><h1>T</h1><p>by me</p></header><p>Body, text.</p></article>", "T\n\nBody, text."),
    "hidden": ('<article><p>Seen, here.</p><p hidden>not</p><div style="display:none">no</div><p aria-hidden="true">no</p></article>', "Seen, here."),
    "no markup": ("only text", "only text"),
    "empty": ("", ""),
    "null": (None, ""),
    "markup only": ("<html><body><nav>x</nav></body></html>", ""),
    "unclosed comment": ("<p>a</p><!-- b", "a"),
    "unclosed script": ("<p>a</p><script>b", "a"),
    "broken quote": ('<p title="it>x</p><p>y</p>', "x\n\ny"),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    page, want = PAGES[name]
    assert H.main_text(page) == want


def test_scores_follow_text_and_punctuation():
    found = H.blocks(f"<body><div>{BODY}</div><ul><li>Home</li><li>About</li></ul></body>")
    scores = H.path_scores(found)
    assert scores["/body/div/p"] > 10 * scores["/body/ul/li"]


def test_long_page():
    page = "<article>" + "".join(f"<p>Paragraph {i}, with text.</p>" for i in range(20_000)) + "</article>"
    assert H.main_text(page).count("\n\n") == 19_999


def test_table(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.IntegerType())])
    rows = [(1, "u", PAGES["article"][0], 1), (1, "u", PAGES["article"][0], 1), (2, None, None, None), (None, "v", "", 3)]
    out = H.extracted(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, "", 0), (1, PAGES["article"][1], len(PAGES["article"][1]))] + [(1, PAGES["article"][1], len(PAGES["article"][1]))] + [(2, "", 0)]
    assert H.extracted(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, tiny):
    got = queries.QUERIES["op1_html_text"](spark, tiny).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert r["n_chars"] == len(r["text"]) and r["text"] == H.main_text(pages[r["page_id"]]) and r["text"]


LONG = "<p>" + "A long paragraph, with words; and more of them, and more. " * 6 + "</p>"


@pytest.mark.parametrize("mark", ["main", "div"])
def test_paths_compete_inside_the_article(mark):
    teasers = "<div>" + "".join(f"<div><h3>Teaser {i}</h3><span>3 min</span></div>" for i in range(4)) + "</div>"
    page = f"<body><{mark}><h1>Head</h1><div>{LONG}<h2>Sub</h2><p>Short one.</p><ul><li>one, two</li><li>three.</li></ul>{LONG}</div><h2>More</h2>{teasers}</{mark}></body>"
    got = H.main_text(page).split("\n\n")
    assert got[0] == "Head" and got[2:6] == ["Sub", "Short one.", "one, two", "three."] and len(got) == 7


def test_mostly_links_below_the_threshold_do_not_join():
    got = H.main_text(f"<main>{LONG}<div><a>Share this</a> now</div><div>Plain line.</div>{LONG}</main>").split("\n\n")
    assert len(got) == 2 or "Plain line." in got and not any("Share" in x for x in got)


@pytest.mark.parametrize("page", [
    '<div class="content has-sidebar"><article>{}</article><div class="sidebar">Side, text.</div></div>',
    '<div class="page no-sidebar"><article>{}</article></div>',
    '<div class="widget"><article>{}</article></div><div class="notice">Note, this.</div>',
    '<div class="layout with-banner">{}<div class="banner">Buy, now.</div></div>',
    '<div class="sidebar-layout">{}<div class="sidebar">Side, text.</div></div>',
    '<form action="/x"><nav>Home</nav>{}<div id="footer">End, of it.</div></form>',
    '<article><div class="widget">{}</div><div class="ad">Buy, buy.</div></article>',
    '<div class="post">{}</div><div id="comments"><article>A reader, at length. A reader, at length. A reader, at length. A reader, at length. A reader, at length.</article></div>',
    '<div id="comments">{}</div>',
])
def test_wrappers_with_boilerplate_words(page):
    assert H.main_text(page.format(BODY)) == WANT


@pytest.mark.parametrize("unit", ["<a ", '<a b="', '<a " > "', "<a ' > ' \"", "<div>x", "<![CDATA[ ", "<!-- ", "<", "<a<", "<?x ", "<p>x", "<div></p>", "</div>", "<script>", '<a b=">'])
@pytest.mark.parametrize("tail", ["", ">", '">'])
def test_broken_pages_take_linear_time(unit, tail):
    """Four times the page takes some four times as long, and not sixteen."""
    took = []
    for size in (1 << 16, 1 << 18):
        page = (unit * size)[:size] + tail
        began = time.process_time()
        H.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 1.5 and took[1] < 9 * took[0] + 0.1


def test_tags_end_where_browsers_end_them():
    assert H.main_text('<p title="a>b">x</p><p title=\'a>"b\'>y</p>') == "x\n\ny"
    assert H.main_text("<p>1 < 2, a <b>c</p>") == "1 < 2, a c"
    assert H.main_text("<p>x<![CDATA[ y ]]>z</p>") == "xz"
    assert H.main_text("<p>x</p><a href=") == "x" and H.main_text("<p>x</p><p") == "x"
    deep = "<div>" * 300 + "<p>in it, far down.</p>" + "</div>" * 300 + "<p>out of it, again.</p>"
    assert H.main_text(deep) == "in it, far down.\n\nout of it, again."


def test_scores_decide_inside_a_marked_article(monkeypatch):
    """With the same score for every path other blocks are taken."""
    teasers = "<div>" + "".join(f"<div><h3>Teaser {i}</h3><span>3 min</span></div>" for i in range(4)) + "</div>"
    page = f"<main><h1>Head</h1><div>{LONG}{LONG}</div><h2>More</h2>{teasers}</main>"
    by_scores = H.main_text(page)
    monkeypatch.setattr(H, "path_scores", lambda found: {b.path: 1.0 for b in found})
    assert "Teaser" not in by_scores and "Teaser" in H.main_text(page)


def test_common_words_and_standfirsts():
    assert H.main_text(f'<article>{BODY}<p class="hidden-gem">A hidden gem, this one here.</p><div class="share-buttons">Share it, now.</div></article>') == f"{WANT}\n\nA hidden gem, this one here."
    stand = "What this is about, in a sentence or two, before the text itself begins."
    assert H.main_text(f"<article><header><h1>T</h1><p>{stand}</p></header>{BODY}</article>") == f"T\n\n{stand}\n\n{WANT}"
    assert H.main_text("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, say.</p></article>") == "Let x=2, say."


class _Tree(HTMLParser):
    """The texts of an article's paragraphs and headings, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.article, self.skip = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.article += 1
        elif tag == "div" and (self.skip or ("class", "ad") in attrs):
            self.skip += 1
        elif self.article and not self.skip and (tag[0] == "h" and tag[1:].isdigit() or tag == "p"):
            self.out.append("")
        elif tag == "br" and self.out:
            self.out[-1] += " "

    def handle_endtag(self, tag):
        self.article -= tag == "article"
        self.skip -= tag == "div" and self.skip > 0

    def handle_data(self, data):
        if self.article and not self.skip and self.out:
            self.out[-1] += data


def test_query_against_a_parsed_tree(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op1_html_text"](spark, folder).collect()}
    for r in spark.read.parquet(f"{folder}/pages.parquet").collect():
        tree = _Tree()
        tree.feed(r["html"])
        tree.close()
        assert got[r["page_id"]] == "\n\n".join(t for t in (" ".join(x.split()) for x in tree.out) if t)


def brute_scores(found):
    """The ratios of each path, from the list of its blocks."""
    out = {}
    for path in {b.path for b in found}:
        own = [b for b in found if b.path == path]
        kin = [b for b in found if b.path.rpartition("/")[0] == path.rpartition("/")[0]]
        mean = lambda f: 0.7 * sum(map(f, own)) / len(own) + 0.3 * sum(map(f, kin)) / len(kin)
        linked = sum(min(b.links, len(b.text)) for b in own) / sum(len(b.text) for b in own)
        out[path] = mean(lambda b: len(b.text)) * (1 + mean(lambda b: sum(c in ".,;:!?" for c in b.text))) * (1 - linked) ** 2
    return out


def test_scores_against_brute_force(spark, tiny):
    for r in spark.read.parquet(f"{tiny}/pages.parquet").limit(20).collect():
        found = H.blocks(r["html"])
        assert H.path_scores(found) == pytest.approx(brute_scores(found))


FOUR = LONG * 4


@pytest.mark.parametrize(("page", "kept"), [
    (f'<article><p>A lead of some signs that stands before the body, and is shorter.</p><div class="body">{FOUR}</div></article>', "A lead of some signs that stands before the body, and is shorter."),
    (f'<article><div class="body">{FOUR}</div><p>A closing line, as it was.</p></article>', "A closing line, as it was."),
    (f"<article><form><div>{FOUR}</div></form><p>A sentence behind it, here.</p></article>", "A sentence behind it, here."),
    (f"<article>{FOUR}<h2>The end</h2></article>", "The end"),
    (f"<article><header><h1>T</h1><p>One sentence about it all.</p></header>{FOUR}</article>", "One sentence about it all."),
    (f"<article>{FOUR}<h2>References</h2><ol>{''.join(f'<li><a href=x>Smith, J. The book of part {i}, 200{i}.</a></li>' for i in range(4))}</ol></article>", "References"),
    (f"<article>{FOUR}<h2>References</h2><ol>{''.join(f'<li><a href=x>Smith, J. The book of part {i}, 200{i}.</a></li>' for i in range(4))}</ol></article>", "Smith, J. The book of part 3, 2003."),
])
def test_text_of_a_marked_article_is_kept(page, kept):
    got = H.main_text(page).split("\n\n")
    assert kept in got and sum(len(t) > 300 for t in got) == 4


@pytest.mark.parametrize(("page", "gone"), [
    (f"<article>{FOUR}<h2>See also</h2><ul><li><a>Home</a></li><li><a>News</a></li><li><a>About us</a></li></ul></article>", ("See also", "Home", "About us")),
    (f"<article><header><h1>T</h1><p>by me</p></header>{FOUR}</article>", ("by me",)),
    ("<div>" * 110 + '<nav>A menu, that is: one.</nav><div class="ad">Buy, buy this now.</div>' + "</div>" * 110 + f"<article>{FOUR}</article>", ("A menu, that is: one.", "Buy, buy this now.")),
    ("<div>" * 110 + f'<nav>A menu, <b>that</b><br> is: one.</nav><div class="ad"><div>Buy, buy this now.</div></div>{FOUR}' + "</div>" * 110, ("A menu, that is: one.", "Buy, buy this now.")),
])
def test_boilerplate_is_left_out(page, gone):
    got = H.main_text(page).split("\n\n")
    assert not set(gone) & set(got) and sum(len(t) > 300 for t in got) == 4


def test_scores_find_articles_without_names(spark, monkeypatch):
    """Pages whose article isn't marked, and all lists of names emptied: the scores find most articles, equal scores far fewer."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = [H.main_text(p) for p in pages]
    bare = [p.replace("<article", "<div").replace("</article", "</div") for p in pages]
    for name in ("NEVER", "BOILERPLATE", "ROLES"):
        monkeypatch.setattr(H, name, frozenset())
    by_scores = sum(H.main_text(b) == w for b, w in zip(bare, want, strict=True))
    monkeypatch.setattr(H, "path_scores", lambda found: {b.path: 1.0 for b in found})
    by_nothing = sum(H.main_text(b) == w for b, w in zip(bare, want, strict=True))
    assert by_scores >= 0.75 * len(pages) and by_scores > 1.2 * by_nothing, (by_scores, by_nothing, len(pages))
