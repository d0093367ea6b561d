"""Main text of web pages, by minimum-cut labelling of their blocks.

A page is cut into blocks of text.  A classifier, trained on blocks whose elements tell what
they are, gives every block a cost for either label, which become the capacities to the
terminals.  Neighbouring blocks, and blocks of one element, are joined by smoothness edges.
The minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmart.llm.common import map_rows
from spanmart.llm.mincut import minimum_cut

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
# Elements, by what they are: fixed values of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = RAW | {"noscript", "template", "svg", "math", "canvas", "object", "audio", "video", "select", "datalist", "button"}
# What a head may hold; any other start tag, and any text, ends it.
IN_HEAD = RAW | {"head", "html", "meta", "link", "base", "noscript", "template", "basefont", "bgsound"}
# Elements that never hold their like: a second start tag ends the first.
FLAT = {"button", "select", "noscript", "datalist"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
    "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
    "sub", "sup", "time", "tt", "u", "var", "wbr",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Elements that hold others; p and headings only begin a block.
HOLDERS = {
    "article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "ul", "ol", "dl", "table",
    "blockquote", "figure", "body", "html", "dialog", "menu", "address", "fieldset", "details", "tr", "td", "li",
}
BLOCKS = HOLDERS | {"p", "pre", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
BOILER_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
# These and roles also stand around whole pages; there they mark nothing.
WRAPPERS = {"form", "fieldset"}
BOILER_NAMES = {
    "ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
    "cookies", "consent", "notice", "gdpr", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "header", "masthead", "comment", "comments", "disqus", "reply", "replies", "share",
    "sharing", "social", "related", "recommended", "newsletter", "subscribe", "signup", "login", "popup", "modal",
    "overlay", "widget", "pagination", "pager", "toolbar", "search", "copyright", "disclaimer", "alert",
}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"}
BOILER_COST, CONTENT_COST = 8.0, 4.0
# A class or id costs less than content and telling text together gain, a part of one less still: the cut decides.
NAME_COST, PART_COST = 5.0, 4.5
BESIDE, SAME, APART = 0.6, 1.2, 0.2
# The model is fitted on the blocks of at most so many pages, and on at most so many blocks.
SAMPLE_PAGES, SAMPLE_BLOCKS = 400, 40_000
FEATURES = 9


@dataclass
class Block:
    text: str
    path: tuple[int, ...]
    tags: tuple[str, ...]
    boiler: bool
    content: bool
    named: float
    linked: float
    heading: bool
    features: np.ndarray = field(default=None)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, unseen elements left out."""
    out: list[Block] = []
    # Tag, number, how it is marked as boilerplate, what its class or id costs.
    stack: list[tuple[str, int, str, float]] = []
    costs: dict[int, float] = {}  # by number
    marked: dict[int, str] = {}  # by number
    bodies: list[tuple[bool, int, tuple[int, ...]]] = []  # of main and article: whether main, number, all that hold it
    parts: list[str] = []
    linked = 0
    links = 0
    heading = False
    unseen: str | None = None
    held: list[str] = []  # what is open within the unseen element
    loose = False  # whether it has no end tag
    in_head = False
    count = 0

    last: dict[str, int] = {}

    def ended(tag: str) -> int:
        """Where the page's last end tag of a kind begins."""
        if tag not in last:
            last[tag] = max((m.start() for m in re.finditer(f"</{tag}", page, re.I)), default=-1)
        return last[tag]

    def close() -> None:
        nonlocal linked, heading
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            tags = tuple(t for t, _, _, _ in stack)
            out.append(
                Block(
                    text, tuple(n for _, n, _, _ in stack), tags, False,
                    any(t in ("article", "main") for t in tags), 0.0, min(1.0, linked / len(text)), heading,
                )
            )
        parts.clear()
        linked = 0

    at, end = 0, len(page)
    while at < end:
        mark = page.find("<", at)
        if mark < 0:
            mark = end
        if mark > at and unseen is None and not (in_head and page[at:mark].isspace()):
            in_head = False
            parts.append(page[at:mark])
            linked += mark - at if links else 0
        if mark == end:
            break
        found = TOKEN.match(page, mark)
        if not found:
            if unseen is None:
                parts.append("<")
            at = mark + 1
            continue
        at = found.end()
        if found[2] is None:
            continue
        tag, closing = found[2].lower(), bool(found[1])
        if not closing and tag in RAW:
            stop = re.compile(f"</{tag}[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if unseen is not None:
            if closing and tag in held:
                del held[len(held) - 1 - held[::-1].index(tag) :]
            elif closing and tag == unseen:
                unseen = None
                continue
            elif closing and any(t == tag for t, _, _, _ in stack) or not closing and loose and tag in BLOCKS:
                # The end of its parent ends it, and without an end tag the next block does.
                unseen = None
            elif not closing and (tag in HOLDERS or tag == unseen and tag not in FLAT):
                held.append(tag)
            if unseen is not None:
                continue
        if in_head and (closing and tag == "head" or not closing and tag not in IN_HEAD):
            in_head = False
        if tag == "head":
            in_head = not closing
            continue
        if not closing and tag in UNSEEN:
            if not found[3].rstrip().endswith("/"):
                unseen, held, loose = tag, [], ended(tag) < at
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        close()
        heading = not closing and len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
        if tag not in HOLDERS:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        else:
            if tag in ("li", "tr", "td") and stack and stack[-1][0] == tag:
                stack.pop()
            count += 1
            inside = any(t in ("article", "main") for t, _, _, _ in stack)
            mark_, cost = _boiler(tag, found[3], inside)
            # Articles in elements of another role are beside the main text.
            barred = {"plain", "role"} if tag == "article" else {"plain"}
            if tag in ("article", "main") and not mark_ and not cost and not any(m in barred for _, _, m, _ in stack):
                bodies.append((tag == "main", count, tuple(n for _, n, _, _ in stack)))
            stack.append((tag, count, mark_, cost))
            costs[count], marked[count] = cost, mark_
            links = 0
    close()
    _named(out, costs, marked, bodies)
    return out


def _named(
    blocks: list[Block], costs: dict[int, float], marked: dict[int, str], bodies: list[tuple[bool, int, tuple[int, ...]]]
) -> None:
    """Give blocks the marks and the cost of the names above them, but for those of holders of the page itself.

    Such a holder has main, or the longest article, or most of the page's text in it: its name tells the layout.
    A form or a role marks nothing where it has main or that article, or nearly all text, in it.
    """
    size: dict[int, int] = {}
    for b in blocks:
        for n in b.path:
            size[n] = size.get(n, 0) + len(b.text)
    total = sum(len(b.text) for b in blocks)
    whole = {n for n, k in size.items() if 2 * k > total}
    around = {n for n, k in size.items() if 10 * k > 9 * total}
    for is_main, _, above in bodies:
        if is_main:
            whole.update(above)
            around.update(above)
    articles = [(size.get(n, 0), -n, above) for is_main, n, above in bodies if not is_main]
    if articles:
        whole.update(max(articles)[2])
        around.update(max(articles)[2])
    for b in blocks:
        b.boiler = any(marked[n] == "plain" or marked[n] and n not in around for n in b.path)
        b.named = max((costs[n] for n in b.path if n not in whole), default=0.0)


def _boiler(tag: str, attributes: str, inside: bool) -> tuple[str, float]:
    """How an element by itself marks what it holds as boilerplate (plain, wrapper, role or not), and the cost of its class or id."""
    if tag in BOILER_TAGS or tag == "header" and not inside:
        return "wrapper" if tag in WRAPPERS else "plain", 0.0
    cost = 0.0
    if not attributes or tag in ("html", "body", "main"):
        return "", cost
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            tokens = set(value.split())
            words = set(re.split(r"[^a-z0-9]+", value))
            if words & BOILER_NAMES and not (tag == "article" and not words & {"comment", "comments", "reply"}):
                if not (inside and words & BOILER_NAMES <= {"header"}):
                    cost = max(cost, NAME_COST if tokens & BOILER_NAMES else PART_COST)
        elif name == "role" and value in BOILER_ROLES:
            return "role", cost
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return "plain", cost
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "plain", cost
    return "", cost


def described(block: Block) -> np.ndarray:
    """Features of the text alone, so that the model carries over to pages without telling elements."""
    text = block.text
    words = text.split(" ")
    n = len(words)
    return np.array([
        1.0, min(n, 80) / 20, float(n < 4), block.linked, float(text[-1] in ".!?:;\"'”»…"),
        min(text.count(".") + text.count(",") + text.count(";"), 10) / 5, float(block.heading),
        float("li" in block.tags), sum(w[:1].isupper() for w in words) / n,
    ])


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, most: int = SAMPLE_BLOCKS, rounds: int = 200) -> list[float]:
    """Weights of a logistic model, from the blocks of at most ``sample`` pages whose elements tell their label.

    The pages are the first by hash, copies counted once, and of their blocks at most ``most``, in order; only
    the blocks' features come to the driver.  Blocks of article or main are content, those of
    navigation, footers and the like are not; others are left out.  Without blocks of both kinds
    the weights are zero, and elements and neighbours alone decide.
    """
    body = F.col("html")
    telling = pages.select(F.col("html").cast("string").alias("html")).where(body.rlike("(?i)<(article|main)[ >]"))
    telling = telling.select("html", F.xxhash64("html").alias("key"))
    keys = [r["key"] for r in telling.select("key").distinct().orderBy("key").limit(sample).collect()]
    picked = telling.where(F.col("key").isin(keys)).dropDuplicates(["key"])

    def run(batch):
        out: dict[str, list] = {"key": [], "at": [], "content": [], "features": []}
        for key, page in zip(batch.column("key").to_pylist(), batch.column("html").to_pylist(), strict=True):
            for i, b in enumerate(blocks_of(page)):
                # A name inside the content tells neither label.
                if b.boiler or bool(b.named) != b.content:
                    out["key"].append(key)
                    out["at"].append(i)
                    out["content"].append(float(b.content and not b.boiler))
                    out["features"].append(described(b))
        return out

    told = map_rows(picked, run, "key long, at long, content double, features array<double>")
    rows = told.orderBy("key", "at").limit(most).collect()
    y = [r["content"] for r in rows]
    if not y or min(y) == max(y):
        return [0.0] * FEATURES
    a, t = np.array([r["features"] for r in rows]), np.array(y)
    weight = np.where(t > 0, 0.5 / t.sum(), 0.5 / (len(t) - t.sum()))
    w = np.zeros(FEATURES)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-a @ w))
        w -= 2.0 * (a.T @ (weight * (p - t)) + 1e-3 * w)
    return w.tolist()


def _marked(block: Block) -> bool:
    return block.boiler or block.named > 0 and not block.content


def labelled(blocks: list[Block], weights: np.ndarray) -> list[bool]:
    """True for the blocks of the main text."""
    costs = []
    for b in blocks:
        cost = -float(np.clip(described(b) @ weights, -3, 3))
        cost += BOILER_COST if b.boiler else b.named
        cost -= CONTENT_COST if b.content else 0.0
        costs.append(cost)
    edges = []
    last: dict[tuple[int, ...], int] = {}
    for i, b in enumerate(blocks):
        if i:
            before = blocks[i - 1]
            shared = sum(1 for p, q in zip(b.path, before.path, strict=False) if p == q)
            apart = len(b.path) + len(before.path) - 2 * shared
            edges.append((i - 1, i, APART if _marked(b) != _marked(before) else BESIDE / (1 + apart)))
        if b.path in last:
            edges.append((last[b.path], i, SAME))
        last[b.path] = i
    return minimum_cut(costs, edges)


def extract(page: str, weights: np.ndarray) -> str:
    blocks = blocks_of(page)
    keep = labelled(blocks, weights) if blocks else []
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def main_texts(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """Per page: page_id, url, text and n_chars.

    Missing or empty pages have an empty text; a missing page_id or url stays missing;
    repeated rows give repeated rows; other columns are ignored.
    """
    plain = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"),
    )
    model = np.array(train(plain) if weights is None else weights)

    def run(batch):
        texts = [extract(h, model) for h in batch.column("html").to_pylist()]
        return {
            "page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
            "n_chars": [len(t) for t in texts],
        }

    return map_rows(plain, run, "page_id long, url string, text string, n_chars long")
