"""Main text of web pages from flat text blocks.

A page is cut into flat blocks at block-level tags.  A block is described by
its own words and link density, those of its neighbours before and after, and
what surrounds it: headings, article-like ancestors, and boilerplate ancestors
(by tag, role, class or id).  Some names of these say what an element holds
(comments, a footer, a notice); others are hints that containers of the main text
have as well (a widget, a page with a sidebar).  The features are the nearest
mark, the share of the page's words under the nearest element of either sort (1
without one), and the share of its words in articles outside boilerplate.  A
decision tree trained on a small labelled table of pages (``html_labels``) says
which blocks are main text.

Edge cases: a null or empty html, or one without main text, gives an empty
text; unclosed tags, comments, scripts and truncated pages end with the page;
repeated page ids are rows of their own; an empty table gives no rows; extra
columns are ignored.  Everything is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.html_labels import labelled_pages
from cadence.llm.textkernels import text_blocks
from cadence.llm.tree import DecisionTree

# Fixed values of HTML: element names by role in the layout.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select button option".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLAIN_TAGS = frozenset("nav footer aside form menu dialog head fieldset".split())
MAIN_TAGS = frozenset("article main".split())
PLAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
PLAIN_WORDS = frozenset(
    "advert adverts advertisement advertising breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies copyright "
    "disclaimer disqus footer footnav gdpr login masthead menu nav navbar navigation newsletter notice notices notification pager "
    "pagination paywall popup related replies reply respond sidenav signup skip sponsor sponsored subscribe tagcloud toolbar topbar".split()
)
HINT_WORDS = frozenset(
    "ad ads banner meta modal promo promoted promotion search share sharing sidebar social tags teaser widget widgets".split()
)
MAIN_WORDS = frozenset("article articlebody body content entry main maincontent post postbody story text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "nearest", "boilerplate_share", "hint_share", "article_share", "article_around", "heading",
)
# Values of "nearest": the sort of the nearest marked element around a block.
ARTICLE, UNMARKED, MIXED, HINT, BOILERPLATE = 0.0, 0.25, 0.5, 0.75, 1.0


def _surroundings(name: str, rest: str) -> tuple[int, int]:
    """Boilerplate (2 by what it says, 1 by a hint) and article marks of an element."""
    plain = 2 * int(name in PLAIN_TAGS or name == "header")
    main = int(name in MAIN_TAGS)
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true":
                plain = 2
            elif key == "style":
                plain = max(plain, 2 * int("display:none" in value.replace(" ", "").lower()))
            elif key == "role":
                plain = max(plain, 2 * int(value.lower() in PLAIN_ROLES))
                main |= int(value.lower() in ("main", "article"))
            elif key in ("class", "id"):
                parts = {p.lower() for p in _NAME_PART.findall(value)}
                plain = max(plain, 2 * int(not parts.isdisjoint(PLAIN_WORDS)), int(not parts.isdisjoint(HINT_WORDS)))
                main |= int(not parts.isdisjoint(MAIN_WORDS))
    return plain, main


def flat_blocks(page: str) -> list[tuple[str, float, float, float, float, float, int, int]]:
    """The page's non-empty blocks in order: text, share of linked words, and
    from ``nearest`` on the features of its surroundings."""
    blocks: list[tuple[str, float, float, int, int, int, int]] = []
    # the boilerplate (hint) element around each boilerplate (hint) element; 0 is the page
    above: tuple[list[int], list[int]] = ([0], [0])
    # open elements: name, boilerplate element, hint element, article, link, heading, nearest mark (all inherited)
    stack: list[tuple[str, int, int, int, int, int, float]] = [("", 0, 0, 0, 0, 0, UNMARKED)]
    pieces: list[tuple[str, int]] = []
    state = stack[0]

    def close_block() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len(p.split()) for p, link in pieces if link)
                words = max(1, sum(len(p.split()) for p, _ in pieces))
                blocks.append((text, linked / words, state[6], state[1], state[2], state[3], state[5]))
            pieces.clear()

    def cut_stack(size: int) -> None:
        nonlocal state
        del stack[size:]
        state = stack[-1]

    at, size = 0, len(page)
    while at < size:
        open_at = page.find("<", at)
        open_at = size if open_at < 0 else open_at
        if open_at > at:
            pieces.append((html.unescape(page[at:open_at]), state[4]))
        if open_at == size:
            break
        m = _TAG.match(page, open_at)
        if not m:
            pieces.append(("<", state[4]))
            at = open_at + 1
            continue
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            if name not in INLINE:
                close_block()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    cut_stack(i)
                    break
            continue
        rest = m["rest"] if m["name"] else m["rest2"]
        if name == "br":
            pieces.append((" ", 0))
            continue
        if name not in INLINE:
            close_block()
            if name in CLOSES_P or name in SAME:
                closing = ("p",) if name in CLOSES_P else SAME[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in closing:
                        cut_stack(i)
                        if name != "tr":
                            break
                    elif stack[i][0] not in INLINE and stack[i][0] not in ("p", "td", "th", "tr"):
                        break
        if name in VOID:
            continue
        if name in RAW:
            if not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            continue
        plain, main = _surroundings(name, rest)
        if name == "header" and state[3] and plain == 2:
            plain = 0  # an article's own header
        if name in ("html", "body"):
            plain = main = 0
        inside = [state[1], state[2]]
        if plain:
            sort = 0 if plain == 2 else 1
            above[sort].append(inside[sort])
            inside[sort] = len(above[sort]) - 1
        nearest = BOILERPLATE if plain == 2 else MIXED if plain and main else HINT if plain else ARTICLE if main else state[6]
        state = (
            name, *inside, int(state[3] or (main and plain < 2)), int(state[4] or name == "a"), int(state[5] or name in HEADINGS), nearest,
        )
        stack.append(state)
    close_block()
    sizes = [len(b[0].split()) for b in blocks]
    total = max(1, sum(sizes))
    article = sum(n for n, b in zip(sizes, blocks) if b[5] and not b[3]) / total
    words_in = [[0] * len(a) for a in above]
    for n, b in zip(sizes, blocks):
        for sort in (0, 1):
            words_in[sort][b[3 + sort]] += n
    for sort in (0, 1):
        for i in range(len(above[sort]) - 1, 0, -1):
            words_in[sort][above[sort][i]] += words_in[sort][i]
    return [(*b[:3], words_in[0][b[3]] / total, words_in[1][b[4]] / total, article, *b[5:]) for b in blocks]


def block_features(blocks: list[tuple]) -> np.ndarray:
    n = len(blocks)
    own = np.zeros((n + 2, 2))
    for i, (text, linked, *_) in enumerate(blocks):
        own[i + 1] = len(text.split()), linked
    marks = np.array([b[2:] for b in blocks], float).reshape(n, 6)
    return np.column_stack([own[1:-1], own[:-2], own[2:], marks])


@lru_cache(maxsize=1)
def block_classifier() -> DecisionTree:
    rows, labels = [], []
    for page, marks in labelled_pages():
        blocks = flat_blocks(page)
        if len(blocks) != len(marks):
            raise ValueError(f"{len(blocks)} blocks, {len(marks)} labels: {page[:60]}")
        rows.append(block_features(blocks))
        labels += [int(c) for c in marks]
    return DecisionTree(max_depth=8, min_leaf=3).fit(np.concatenate(rows), np.array(labels))


def main_texts(pages: list[str], tree: DecisionTree) -> list[str]:
    split = [flat_blocks(p) for p in pages]
    features = [block_features(b) for b in split if b]
    keep = tree.predict(np.concatenate(features)) >= 0.5 if features else np.empty(0, bool)
    out, at = [], 0
    for blocks in split:
        out.append(" ".join(b[0] for b, k in zip(blocks, keep[at : at + len(blocks)]) if k))
        at += len(blocks)
    return out


def _extract(tree: DecisionTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, 2):
            texts = main_texts([x or "" for x in block.column(2).to_pylist()], tree)
            yield pa.RecordBatch.from_arrays(
                [block.column(0), block.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )

    return run


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: DecisionTree | None = None
) -> DataFrame:
    """Id, url, ``text`` and ``n_chars`` (code points) per page."""
    id_type = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    out = slim.mapInArrow(_extract(tree or block_classifier()), f"id {id_type}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
