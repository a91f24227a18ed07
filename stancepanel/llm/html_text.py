"""Main text of web pages by the maximum-scoring subsequence.

A page is a row of items: words of text, which score positive, and tags, which score negative. Weights are log-odds
learned from pages whose markup says where the article is. One linear scan finds the contiguous region with the best
score; blocks in it are the text, but for elements that are never part of it.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stancepanel.llm.common import arrow_map

# Element names by what they do.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object")
SET_APART = ("nav", "footer", "aside", "form", "head", "header", "menu", "dialog", "button", "select", "label", "fieldset")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
          "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul")
FOREIGN = ("svg", "math")
LINES = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Class and id words of menus, notices, adverts and reader comments.
ASIDE_WORDS = ("ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "breadcrumbs", "byline", "comment",
               "comments", "consent", "cookie", "cookies", "disclaimer", "discussion", "footer", "header", "menu", "nav",
               "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted",
               "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor",
               "sponsored", "subscribe", "toolbar", "widget")

ITEM = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                  r"<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"\shidden(?:[\s=/]|\Z)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
WORD = re.compile(r"\S+")

#: Weights used where no page of the table has labels.
DEFAULT_WEIGHTS = {"word": 3.0, "aside": -0.1, "tag": -0.5, "link": -3.0}
#: The lowest weights. Words set apart are never taken, so they must not cut an article around an advert in two.
LOWEST = {"aside": -0.2, "tag": -6.0, "link": -3.0}


def _names_aside(name: str, attributes: str) -> bool:
    """Whether class, id or role has a word of ASIDE_WORDS; of a paragraph or heading, as the last word of a name."""
    named = " ".join(a or b or c for a, b, c in ATTRIBUTE.findall(attributes))
    names = [re.split(r"[_-]+", n) for n in re.sub(r"([a-z])([A-Z])", r"\1-\2", named).lower().split()]
    return any(w in ASIDE_WORDS_SET for n in names for w in (n[-1:] if name in LINES else n))


@dataclass
class Element:
    apart: bool  # by its name, or hidden
    named: bool  # by the words of its class, id or role
    within: bool  # inside an article or main element
    held: bool  # has an inside
    words: int  # words of the page before it, once it has ended: words in it
    main: bool = False
    article: bool = False
    title: bool = False

    def out(self, words: int) -> bool:
        """Whether it is set apart on a page of so many words; wrappers of the article are not, whatever they are named."""
        half = 2 * self.words >= words > 0
        wraps = (self.main or self.title and self.within or (self.title or self.article) and half
                 or 10 * self.words >= 9 * words > 0)
        return self.apart or self.named and not wraps


def _parsed(page: str):
    """('text', text, None), ('open', name, element) and ('close', name, elements that end) in page order, and the
    number of words outside elements that are set apart by name or hidden."""
    out, open_ = [], []
    at = words = depth = 0

    def text(value: str) -> None:
        nonlocal words
        out.append(("text", value, None))
        if not depth:
            words += len(WORD.findall(value))

    while at < len(page):
        m = ITEM.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            text(page[at:end])
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if m[0].startswith("<![CDATA["):
            text(html.escape(m[0][9:].removesuffix("]]>")))
        if not name:
            continue
        if m[1]:
            ended = []
            if any(name == n for n, _ in open_):
                while not ended or ended[-1][0] != name:
                    ended.append(open_.pop())
                    ended[-1][1].words = words - ended[-1][1].words
                    depth -= ended[-1][1].apart
            out.append(("close", name, [e for _, e in ended]))
            continue
        closed = m[3].rstrip().endswith("/")
        if name in RAW:
            if closed and name in FOREIGN:
                continue
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else at if closed else len(page)
            continue
        within = any(n in ("article", "main") for n, _ in open_)
        apart = name in SET_APART and not (name == "header" and within)
        whole = name in ("html", "body", "article", "main")
        named = bool(m[3]) and name not in ("html", "body") and _names_aside(name, m[3])
        if name in ("main", "article", "h1"):
            for _, e in open_:
                e.main |= name == "main"
                e.article |= name == "article" and not named
                e.title |= name == "h1"
        element = Element(apart or (not whole and bool(HIDDEN.search(m[3]))), named and not whole, within,
                          name not in VOID and not closed, words)
        out.append(("open", name, element))
        if element.held:
            open_.append((name, element))
            depth += element.apart
    for _, e in open_:
        e.words = words - e.words
    return out, words


def items(page: str):
    """('text', text, apart), ('tag', name, apart, closing) in page order; `apart`: inside an element set apart.

    An element set apart ends at its own end tag, at an end tag of an element around it, or with the page. Scripts,
    styles and other raw elements end only at their own end tag; svg and math may close themselves.
    """
    parsed, words = _parsed(page)
    depth, inside = 0, set()
    for what, value, of in parsed:
        if what == "text":
            yield ("text", value, depth > 0, False)
        elif what == "close":
            for e in of:
                if id(e) in inside:
                    inside.discard(id(e))
                    depth -= 1
            yield ("tag", value, depth > 0, True)
        else:
            out = of.out(words)
            yield ("tag", value, depth > 0 or out, False)
            if out and of.held:
                inside.add(id(of))
                depth += 1


ASIDE_WORDS_SET = frozenset(ASIDE_WORDS)


def kinds(page: str):
    """(kind, words, inside) of each item of a page; inside: within the element that marks the article, if any."""
    inside, marks = 0, 0
    for what, value, apart, closing in items(page):
        if what == "text":
            yield ("aside" if apart else "word", len(WORD.findall(value)), inside > 0 and not apart)
            continue
        if value in ("article", "main"):
            inside = max(0, inside + (-1 if closing else 1))
            marks += 1
        yield ("link" if value in ("a", "li") else "tag", 1, inside > 0 and not apart)


def label_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """kind, inside, n: items of all pages whose markup labels the article."""
    def step(batch: pa.RecordBatch) -> pa.Table:
        counts: dict[tuple[str, bool], int] = {}
        for page in batch.column(0).to_pylist():
            if page and re.search(r"<(?:article|main)[\s>]", page, re.IGNORECASE):
                for kind, n, inside in kinds(page):
                    counts[kind, inside] = counts.get((kind, inside), 0) + n
        keys = list(counts)
        return pa.table({"kind": pa.array([k for k, _ in keys], pa.string()),
                         "inside": pa.array([i for _, i in keys], pa.bool_()),
                         "n": pa.array([counts[k] for k in keys], pa.int64())})

    found = arrow_map(pages.select(html_col), step, "kind string, inside boolean, n long")
    return found.groupBy("kind", "inside").agg(F.sum("n").alias("n"))


def learned_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Log-odds of lying inside the article for each of the four kinds of item; signs are kept as the method has them.

    The counts are over all pages; only eight numbers reach the driver.
    """
    n = {(r["kind"], r["inside"]): r["n"] for r in label_counts(pages, html_col).collect()}
    if not n:
        return dict(DEFAULT_WEIGHTS)
    out = {}
    for kind, usual in DEFAULT_WEIGHTS.items():
        a, b = n.get((kind, True), 0) + 0.5, n.get((kind, False), 0) + 0.5
        odds = math.log(a / b)
        out[kind] = max(0.1, min(6.0, odds)) if usual > 0 else min(-0.05, max(LOWEST[kind], odds))
    return out


def main_text(page: str, weights: dict[str, float]) -> str:
    """The best contiguous region's blocks, one line each."""
    seen = list(items(page))
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for i, (what, value, apart, _) in enumerate(seen):
        if total <= 0:
            total, start = 0.0, i
        if what == "text":
            total += weights["aside" if apart else "word"] * len(WORD.findall(value))
        else:
            total += weights["link" if value in ("a", "li") else "tag"]
        if total > best:
            best, region = total, (start, i + 1)
    blocks, held = [], []
    for what, value, apart, _ in seen[region[0]:region[1]] + [("tag", "p", False, False)]:
        if what == "text":
            if not apart:
                held.append(html.unescape(value))
        elif value == "br":
            held.append(" ")
        elif value in BLOCKS:
            text = " ".join("".join(held).split())
            held = []
            if text:
                blocks.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url",
            html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every whole page.

    Without `weights` they are learned from the table. A null or empty page has an empty text. White space is what
    str.split takes for it. Repeated rows, null keys and null addresses stay; an empty table gives an empty result. Pages of
    any length are read whole, further columns are not read.
    """
    weights = learned_weights(pages, html_col) if weights is None else weights

    def step(batch: pa.RecordBatch) -> pa.Table:
        texts = [main_text(p or "", weights) for p in batch.column("html").to_pylist()]
        return pa.table({"page_id": batch.column("page_id"), "url": batch.column("url"),
                         "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())})

    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kind, address = (rows.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return arrow_map(rows, step, f"page_id {kind}, url {address}, text string, n_chars long")
