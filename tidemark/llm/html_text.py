"""Main text of web pages by composite text density.

A page becomes a small DOM.  Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments by readers are cut by their element
names, roles and class words.  A class word alone does not cut what wraps an
article or main element, nor what holds over three quarters of the characters
outside links; density decides there.  Inside an article a name cuts only if all
its parts speak of furniture (`user-comments`, not `related-work`), and words that an
author may use as well (`notice`, `legal`, `related`, `form`) cut only blocks that are
short or mostly links.  An article element is cut if its class calls it a comment.
Buttons and labels belong to the text where they stand in a paragraph or heading of an
article, formulas everywhere.  Of what is left every node gets its link-adjusted
characters per tag

    density = C / T * log(C / max(LC, 1) * T / max(LT, 1) + e  ,  base ln(C * LC / max(C - LC, 1) + LCb * C / Cb + e))

(C characters, T tags, LC and LT those of links, b the body), and a node's score
is the sum of its children's densities, its own text counting as a child.  The
subtree with the greatest score is the article; the least density on the path
from it to the body is the threshold at which blocks beside that path join it.
This chooses on every page.  An ``article`` or ``main`` element is no more than a
boundary: where the winner lies in one, the nearest is taken whole in its place.

The text of a block has its white space turned into single spaces; blocks are
joined by one newline in page order.

Edge cases: a null, empty or textless page gives the empty text; broken nesting,
unclosed tags and comments and stray end tags are read as browsers do where it
matters for blocks; very long pages take one pass; repeated rows are
independent; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens as tk

# Fixed values of HTML: elements without content, with raw content, and those that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("br td th tr tbody thead tfoot caption option optgroup legend body html".split())
# An opening tag ends these open elements, up to (not through) the listed containers.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
           "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
           "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
CUT = frozenset(
    "nav footer aside form script style noscript template iframe svg button select textarea input dialog menu head title object "
    "embed canvas audio video map noembed noframes xmp label annotation annotation-xml".split()
)
SPOKEN = frozenset("button label".split())  # kept in the prose of an article
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dd figcaption".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars aside nav navbar "
    "navigation menu menus breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
    "disqus respond replies related recommended recommendations share sharing social widget widgets search form copyright legal "
    "disclaimer skip toc".split()
)

# Furniture words that an author may use for a part of the article, and the words for a reader's comment.
AMBIGUOUS = frozenset(
    "notice notices legal related recommended recommendations form search header footer aside copyright disclaimer toc alert promotion "
    "menu menus respond replies login signup skip overlay banner navigation advertising sponsored widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
# Parts of class names that say nothing of their own.
PLAIN_PARTS = frozenset(
    "area bar block body bottom box col column container content count desktop entry group icon icons inline inner item items left link "
    "links list lower main mobile outer page panel post reader right row section side site slot small text title top unit upper user "
    "wrap wrapper".split()
)
SHORT = 120  # characters outside links; a block under an ambiguous name that has fewer is furniture

WRAPS = 3, 4  # an element with a larger share of the characters outside links is no furniture

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<![^>]*>?|<\?[^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPACES = re.compile(r"\s+")
WORD_EDGE = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "children", "cut", "worded", "marked", "chars", "tags", "link_chars", "link_tags", "density", "score")

    def __init__(self, tag: str, cut: bool = False, worded: str = ""):
        self.tag, self.cut, self.worded, self.marked, self.children = tag, cut, worded, False, []


def parts(name: str) -> list[str]:
    return [p for p in WORD_EDGE.split(CAMEL.sub("-", name).lower()) if p]


def has_cut_word(value: str) -> bool:
    return not CUT_WORDS.isdisjoint(parts(value))


def named_only(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names has a word of the set, and no part that is neither such nor plain."""
    for name in value.split():
        found = parts(name)
        if not words.isdisjoint(found) and all(p in words or p in PLAIN_PARTS or p.isdigit() for p in found):
            return True
    return False


def is_cut(tag: str, attributes: str, inside: bool, prose: bool = False) -> tuple[bool, str]:
    """Whether an element is furniture, and what says so if it is a name alone: `word`, or `maybe` for an ambiguous one.

    `inside` an article a heading group is none, and in its `prose` neither is a button or label.
    """
    if tag in CUT and not (inside and prose and tag in SPOKEN) or tag == "header" and not inside:
        return True, ""
    if not attributes or tag in ("html", "body", "main"):
        return False, ""
    worded = ""
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            if tag == "article":
                worded = "word" if named_only(value, COMMENT_WORDS) else worded
            elif not inside:
                worded = "word" if has_cut_word(value) else worded
            elif tag not in ("h1", "h2", "h3", "p"):
                if named_only(value, CUT_WORDS - AMBIGUOUS):
                    worded = "word"
                elif named_only(value, CUT_WORDS):
                    worded = worded or "maybe"
        elif tag == "article":
            continue
        elif name == "role" and value.lower() in CUT_ROLES:
            return True, ""
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, ""
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
    return bool(worded), worded


def parse(page: str) -> Node:
    """The DOM of a page: nodes and text pieces, character references still in place."""
    root = Node("html")
    open_nodes, at, articles = [root], 0, 0

    def close(to: int) -> None:
        nonlocal articles
        for n in open_nodes[to:]:
            articles -= n.tag in ("article", "main")
        del open_nodes[to:]

    for m in TAG.finditer(page):
        if m.start() < at:
            continue  # inside raw content
        if m.start() > at:
            open_nodes[-1].children.append(page[at : m.start()])
        at = m.end()
        if m.group(1):
            tag = m.group(1).lower()
            where = next((i for i in range(len(open_nodes) - 1, 0, -1) if open_nodes[i].tag == tag), 0)
            if where and (tag in BLOCKS or not any(n.tag in BLOCKS for n in open_nodes[where + 1 :])):
                close(where)
            continue
        if not m.group(2):
            continue
        tag, attributes = m.group(2).lower(), m.group(3)
        if tag in CLOSES_P:
            for i in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[i].tag == "p":
                    close(i)
                    break
                if open_nodes[i].tag in BLOCKS:
                    break
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            for i in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[i].tag in stop:
                    break
                if open_nodes[i].tag in ends:
                    close(i)
        prose = tag in SPOKEN and next((n.tag in PROSE for n in reversed(open_nodes) if n.tag in BLOCKS), False)
        node = Node(tag, *is_cut(tag, attributes, articles > 0, prose))
        if tag in ("article", "main") and not any(has_cut_word(v) for k, v in ATTRIBUTE.findall(attributes) if k.lower() in ("class", "id")):
            for n in reversed(open_nodes) if all(n.tag != "article" for n in open_nodes) else ():  # not a card inside an article
                if n.marked:
                    break
                n.marked = True
        open_nodes[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not attributes.endswith("/") or tag in BLOCKS and tag not in VOID:
            open_nodes.append(node)
            articles += tag in ("article", "main")
    if at < len(page):
        open_nodes[-1].children.append(page[at:])
    return root


def keep_wrappers(root: Node) -> None:
    """Undo cuts by a class or id word around an article, around most of the characters outside links, and, under an
    ambiguous name inside an article, around a block of text."""
    nodes, todo = [], [root]
    while todo:
        n = todo.pop()
        nodes.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node) and (c.worded or not c.cut))
    if not any(n.worded for n in nodes):
        return
    for n in reversed(nodes):
        n.chars = n.link_chars = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c) - c.count(" ") if not c.isspace() else 0
            elif c.worded or not c.cut:
                n.chars += c.chars
                n.link_chars += c.link_chars
        if n.tag == "a":
            n.chars, n.link_chars = 0, n.link_chars + n.chars
    for n in nodes:
        if n.worded and (n.marked or n.chars * WRAPS[1] > root.chars * WRAPS[0]):
            n.cut = False
        elif n.worded == "maybe" and n.chars >= SHORT and n.chars > n.link_chars:
            n.cut = False


def ordered(root: Node) -> list[Node]:
    """All kept nodes, parents first."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(c for c in n.children if isinstance(c, Node) and not c.cut)
    return out


def measure(nodes: list[Node]) -> None:
    """Characters, tags, link shares, densities and scores, children before parents."""
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for c in n.children:
            if isinstance(c, str):
                n.chars += len(c) - c.count(" ") if not c.isspace() else 0
            elif not c.cut:
                n.chars += c.chars
                n.tags += c.tags + 1
                n.link_chars += c.link_chars
                n.link_tags += c.link_tags
        if n.tag == "a":  # all of it is link
            n.link_chars, n.link_tags = n.chars, n.tags + 1
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for n in reversed(nodes):
        n.density = density(n.chars, max(n.tags, 1), n.link_chars, n.link_tags, share)
        own = sum(len(c) for c in n.children if isinstance(c, str) and not c.isspace())
        n.score = n.density if n.tag == "a" else density(own, 1, 0, 0, share) + sum(c.density for c in n.children if isinstance(c, Node) and not c.cut)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    base = math.log(chars * link_chars / max(chars - link_chars, 1) + share * chars + math.e)
    inner = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(inner + math.e) / max(base, 1.0)


def choose(root: Node) -> set[int]:
    """Identities of the subtrees that make up the article."""
    nodes = ordered(root)
    measure(nodes)
    parent = {id(c): n for n in nodes for c in n.children if isinstance(c, Node) and not c.cut}
    body = next((n for n in nodes if n.tag == "body"), root)
    best = max(nodes, key=lambda n: n.score)
    path = [best]
    while id(path[-1]) in parent and path[-1] is not body:
        path.append(parent[id(path[-1])])
    threshold = min(n.density for n in path)
    bound = next((i for i, n in enumerate(path) if n.tag in ("article", "main")), 0)
    path = path[bound:]
    chosen = {id(path[0])}
    for n in path[1:]:
        for c in n.children:
            if isinstance(c, Node) and not c.cut and c not in path and c.chars and c.density >= threshold and c.link_chars * 2 < c.chars:
                chosen.add(id(c))
    return chosen


def blocks(root: Node, chosen: set[int]) -> Iterator[str]:
    """Text of the chosen subtrees, a block at a time."""
    piece: list[str] = []
    todo: list[tuple[Node | str | None, bool]] = [(root, id(root) in chosen)]
    while todo:
        n, taken = todo.pop()
        if n is None:  # the edge of a block
            if text := flat(piece):
                yield text
            piece = []
        elif isinstance(n, str):
            if taken:
                piece.append(n)
        elif not n.cut:
            inside = taken or id(n) in chosen
            edge = n.tag in BLOCKS or inside and not taken
            if edge:
                todo.append((None, inside))
            todo.extend((c, inside) for c in reversed(n.children))
            if edge:
                todo.append((None, inside))
    if text := flat(piece):
        yield text


def flat(pieces: list[str]) -> str:
    return SPACES.sub(" ", html.unescape("".join(pieces))).strip() if pieces else ""


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    keep_wrappers(root)
    return "\n".join(blocks(root, choose(root)))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches):
        for batch in batches:
            for rows in tk.slices(batch, "html"):
                text = [main_text(p) for p in rows.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("page_id"), rows.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
