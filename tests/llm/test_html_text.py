import html
import re

import pyarrow.dataset as ds
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.html_text import extract, main_text

SF = "/root/testdata/sf0.01"
LONG = "Some words of a real paragraph, long enough to count as the text of the page. " * 3


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<!-- a <p>x</p> --><p>y</p>", "y"),
    ("<body><p>a &amp; b&nbsp;c&#33; &lt;p&gt;</p></body>", "a & b c! <p>"),
    ("<article><h1>T</h1><p><b>one<br><p>two\n  three</p></article><footer>f</footer>", "T\none\ntwo three"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
    ("<article><p>x <a href='u>v'>link</a> y</p><script>var a = '</p><p>no';</script></article>", "x link y"),
    ("<article><header><h1>Head</h1></header><p>body</p><section class='comments'><p>first!</p></section></article>", "Head\nbody"),
    ("<article><p>a</p><form><input name=q>Search</form><aside>side</aside><div role='alert'>!</div></article>", "a"),
    ("<article><p>open<div>next</article><div class=ad>buy</div>", "open\nnext"),
    ("<p>a<style>p{}</style>b", "ab"), ("<article>un<b>bo</b>ld</article>", "unbold"), ("</p></div><p>a</i>b</p>", "ab"),
    ("<script>never closed <p>x</p>", ""), ("<article><p>é 🙂</p></article>", "é 🙂"),
])
def test_pages(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("box", ["<nav>%s</nav>", "<div class='sidebar-left'>%s</div>", "<div id='siteFooter'>%s</div>", "<header>%s</header>",
                                 "<div class='cookie notice'>%s</div>", "<div class='user-comments'>%s</div>", "<form>%s</form>"])
def test_density_finds_an_unmarked_article(box):
    extra = box % ("<p>" + LONG * 4 + "</p>")
    links = "<div>" + "<a href='/x'>a link to some other page</a> " * 20 + "</div>"
    page = f"<html><body>{links}{extra}<div><div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></div>{links}</body></html>"
    assert main_text(page) == f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_text_beside_an_article_is_not_lost():
    text = f"<h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    flat = f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"
    links = "<div>" + "<a href='/x'>a link to some other page</a> " * 20 + "</div>"
    card = "<article class='card'><a href='/y'>Read this one too</a></article>"
    assert main_text(f"<body>{links}{card}<div><div>{text}</div></div>{links}</body>") == flat
    assert main_text(f"<body>{links}<article>{text}</article><article>{text}</article>{links}</body>") == f"{flat}\n{flat}"
    assert main_text(f"<body>{links}<article><h1>Head</h1><div>{text}</div></article>{links}</body>") == f"Head\n{flat}"


@pytest.mark.parametrize("wrap", ["<div class='site has-sidebar'>%s</div>", "<div id='content' class='no-sidebar'>%s</div>",
                                  "<div class='page header-fixed'>%s</div>", "<div class='post share-enabled'>%s</div>"])
@pytest.mark.parametrize("mark", ["<article>%s</article>", "<main><article>%s</article></main>", "<div>%s</div>"])
def test_a_class_word_does_not_cut_the_wrapper(wrap, mark):
    text = f"<h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    side = "<div class='sidebar'><p>A few words at the side.</p></div><div class='share'>Tell it</div>"
    links = "<div class='menu'>" + "<a href='/x'>a link to some other page</a> " * 20 + "</div>"
    related = "<div class='related'><article class='card'><p>Another text</p></article></div>"
    page = f"<html><body>{links}{wrap % (mark % (text + related * ('article' in mark)) + side)}</body></html>"
    assert main_text(page) == f"Title\n{LONG.strip()}\nShort.\n{LONG.strip()}"


def test_comments_around_marked_cards_stay_cut():
    cards = "".join(f"<article class='comment' id='c{i}'><p>Nice, number {i}.</p></article>" for i in range(3))
    assert main_text(f"<article><p>{LONG}</p></article><div id='comments'>{cards}</div>") == LONG.strip()


@pytest.mark.parametrize("name", ["class='related-work'", "class='legal-analysis'", "class=notice", "id=form", "id='search-results-in-mice'", "class='share-prices'",
                                  "class='toc'", "class='social-policy ad-hoc'", "id='comment-on-the-method'", "class='menu-of-options'"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_an_oddly_named_block_of_an_article_stays(name, tag):
    page = f"<article><h1>T</h1><p>{LONG}</p><{tag} {name}><h2>Part</h2><p>{LONG}</p></{tag}><p>{LONG}</p></article><footer>f</footer>"
    assert main_text(page) == f"T\n{LONG.strip()}\nPart\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("name", ["class=ad", "class='ad-box top'", "class='user-comments'", "id=comments", "class=share", "class='social-links'", "class='newsletter-box'",
                                  "class='cookie notice'", "class=notice", "class='related'", "id=disqus"])
def test_furniture_inside_an_article_goes(name):
    links = "<a href='/x'>another page of this site</a> " * 9
    inner = links if "related" in name else "<p>Some words that are none of the article.</p>"
    assert main_text(f"<article><p>{LONG}</p><div {name}>{inner}</div><p>{LONG}</p></article>") == f"{LONG.strip()}\n{LONG.strip()}"


def test_prose_keeps_formulas_buttons_and_labels():
    page = (f"<article><p>{LONG}</p><p>Press <button>OK</button> beside <label>Name</label> when <math><mi>x</mi><mo>=</mo><mn>2</mn>"
            "<annotation encoding='tex'>x=2</annotation></math> holds.</p><div><button>Share</button></div><form><label>Mail</label></form></article>")
    assert main_text(page) == f"{LONG.strip()}\nPress OK beside Name when x=2 holds."


@pytest.mark.parametrize("card", ["class=comment", "class='comment even depth-1' id=c4", "id='comment-12'", "class='user-comment'"])
def test_an_article_that_is_a_comment_goes(card):
    said = f"<article {card}><p>A reader found this very long and said so at some length, twice.</p></article>"
    text = f"<h1>T</h1><p>{LONG}</p><p>{LONG}</p>"
    assert main_text(f"<body><article>{text}</article>{said * 2}</body>") == f"T\n{LONG.strip()}\n{LONG.strip()}"
    assert main_text(f"<body><main><article class='post comment-open'>{text}{said}</article></main></body>") == f"T\n{LONG.strip()}\n{LONG.strip()}"


@given(st.lists(st.tuples(st.sampled_from(["div", "section", "p", "blockquote"]), st.text("abcdefghijklmnopqrstuvwxyz-", min_size=1, max_size=12),
                          st.booleans()), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_blocks_of_an_article_under_any_name_stay(blocks):
    inner = "".join(f"<{tag} class='{name}-study'>{'<b>' * bold}{LONG}{i}{'</b>' * bold}</{tag}>" for i, (tag, name, bold) in enumerate(blocks))
    links = "<nav>" + "<a href='/x'>a link</a> " * 9 + "</nav>"
    got = main_text(f"<body>{links}<article><h1>T</h1>{inner}</article>{links}</body>").split("\n")
    assert got == ["T", *[f"{LONG}{i}" for i in range(len(blocks))]]


def test_given_pages(spark):
    rows = {r["page_id"]: r for r in ds.dataset(f"{SF}/pages.parquet").to_table().to_pylist()}
    got = extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id]["html"], re.S)[1]
        parts = re.split(r"<(?:/?p|/?h1|br)>", inner)
        flat = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts]
        assert r.text == "\n".join(x for x in flat if x)
        assert r.n_chars == len(r.text) and r.url == rows[r.page_id]["url"]


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, None, None, 1, ""), (None, "u", "<p>a</p>", 1, ""), (2, "u", "<p>a</p>", 1, ""), (2, "u", "<p>a</p>", 1, ""),
            (3, "u", "<div>" * 20_000 + "deep", 1, ""), (4, "u", "<article>" + "<p>x" * 100_000, 1, "")]
    got = sorted((r.page_id or 0, r.n_chars) for r in extract(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 1), (1, 0), (2, 1), (2, 1), (3, 4), (4, 199_999)]
    assert extract(spark.createDataFrame([], schema)).collect() == []
