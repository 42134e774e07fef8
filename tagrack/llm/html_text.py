"""Main text of web pages with site templates removed.

Every page is read into a light element tree. The subtrees that could belong to
a site's frame are hashed, and Spark counts each hash once per page and host.
A subtree met on ``LEAST_PAGES`` different pages of its host, however many pages
the host has, is template and is deleted, beside elements that say themselves
that they are navigation, adverts, forms and the like. What remains of the
article is the text.

Only containers can be templates: no inline element, heading or paragraph,
no list, table or figure of running text (lists of links can), no passage of
``PASSAGE_WORDS`` words without links, nothing that holds an article or most of the
page's text (but a bare ``div`` of under ``SENTENCE_WORDS`` words). Pages are told apart by their three longest blocks of text, so copies of
one article, which share them, count as one page however they are framed.

Defined cases. A null or empty page, and one of markup only, has an empty text.
A null or odd url is a host of its own name (empty); repeated rows are pages of
their own. Unclosed and stray tags are read as browsers do, in the main, nested to
any depth. An
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, small_batches, written

LEAST_PAGES = 5
# Longest list of a host's templates that is handed to each of its pages whole;
# of longer ones every page gets those it has itself.
MOST_LISTED = 10_000

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes noembed".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section
summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body caption html tbody td tfoot th thead tr legend dt dd li".split()) | {"li", "dd", "dt"}
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
                "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
                "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
                "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
# Elements that are no article text wherever they stand.
NEVER = frozenset("""nav footer aside form script style noscript iframe template button select option input textarea
dialog menu svg canvas object embed head title noframes noembed audio video map search""".split())
MARKED = re.compile(r"""(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adslot|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|
    newsletter|subscribe|subscription|paywall|sidebar|side|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|
    comments?|commentlist|disqus|replies|social|share|sharing|related|recommended|popup|modal|overlay|toolbar|widget|
    login|signup|skip)(?:$|[\s_-])""", re.I | re.X)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
# Of these a class inside an article may speak of its matter (side by side, related
# work): there the element goes only if it is mostly links.
OPEN_MARKS = re.compile(r"""(?:^|[\s_-])(?:adv|notices?|alert|side|menu|social|share|sharing|related|recommended|overlay|widget|
    replies|skip|banner|promo|subscription)(?:$|[\s_-])""", re.I | re.X)
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th tr tbody b i em strong a span code br u s".split())
# What can be a site's template, and of those what can be so only if it is mostly links.
CONTAINERS = frozenset("div section header footer nav aside form center fieldset menu ul ol dl table figure".split())
OF_LINKS = frozenset("ul ol dl table figure menu".split())
PASSAGE_WORDS = 50
SENTENCE_WORDS = 10
LONGEST_BLOCKS = 3

# As in browsers a quote counts after = only, and an open tag, quote or comment ends
# with the page. No part takes a step back, so a page is read once.
_TOKEN = re.compile(r"""<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z)""", re.X)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


@dataclass
class Node:
    tag: str
    marks: str = ""
    drop: bool = False
    in_article: bool = False
    doubt: bool = False  # to be dropped if it is mostly links
    children: list = field(default_factory=list)  # Node or text


def _attributes(tag: str, source: str) -> tuple[str, bool, bool]:
    """(class and id, whether the attributes say boilerplate, whether only by a
    word that may also speak of the matter)."""
    if not source.strip():
        return "", False, False
    found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(source)}
    marks = f"{found.get('class', '')} {found.get('id', '')}".strip()
    said = bool(marks and MARKED.search(marks))
    sure = found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    # words of the open kind out, is there still one that says it?
    doubt = said and not sure and not MARKED.search(" ".join(OPEN_MARKS.sub("  ", f" {marks} ".replace(" ", "  ")).split()))
    return marks, said or sure, doubt


def parse(page: str | None) -> Node:
    """The element tree of a page; text is kept as written, still escaped."""
    page = page or ""
    root = Node("#root")
    stack, at, end = [root], 0, len(page)

    doubtful: list[Node] = []
    open_tags: Counter = Counter()  # a tag that is not open is not searched for in a deep stack

    def close_to(i: int) -> None:
        open_tags.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[i].tag == tag:
                    close_to(i)
                    break
                if stack[i].tag in ("article", "main", "table", "body") and tag not in ("body", "html"):
                    break  # a stray end tag does not close what holds the content
            continue
        if tag in CLOSES_P and open_tags["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close_to(i)
                    break
                if stack[i].tag in BLOCK or stack[i].tag == "button":
                    break
        if tag in SELF_CLOSING:
            closed, within = SELF_CLOSING[tag]
            for i in range(len(stack) - 1, 0, -1) if any(open_tags[x] for x in closed) else ():
                if stack[i].tag in within:
                    break
                if stack[i].tag in closed:
                    close_to(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        marks, said, doubt = _attributes(tag, m[3])
        main = tag in ("article", "main", "body", "html")
        inside = stack[-1].in_article or stack[-1].tag in ("article", "main")
        # a header outside the article is the site's, inside it holds the title
        drop = not (main and not (tag == "article" and said)) and (tag in NEVER or said or tag == "header" and not inside)
        doubt = doubt and inside and drop and tag not in NEVER
        node = Node(tag, marks, drop and not doubt, inside, doubt)
        if doubt:
            doubtful.append(node)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            node.children.append(page[at:close.start() if close else end])
            at = close.end() if close else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    if doubtful:
        sizes = measures(root)
        for node in doubtful:
            all_, linked, *_ = sizes[id(node)]
            node.drop = 2 * linked >= all_
    return root


def measures(root: Node) -> dict[int, tuple[int, int, int, bool, bool]]:
    """By id() of every element: letters of its text, of them in links, its words,
    whether it holds other blocks, and whether it holds an article. Dropped elements count for nothing."""
    out: dict[int, tuple[int, int, int, bool, bool]] = {}
    for node in [*reversed(_nodes(root)), root]:  # children before their parents
        size = linked = words = 0
        blocks = article = False
        for c in node.children:
            if isinstance(c, str):
                split = c.split()
                words += len(split)
                size += sum(map(len, split))
            elif not c.drop:
                s, l, w, b, a = out[id(c)]
                size, linked, words = size + s, linked + l, words + w
                blocks, article = blocks or b or c.tag in BLOCK, article or a
        out[id(node)] = (size, size if node.tag == "a" else linked, words, blocks, article or node.tag in ("article", "main", "body"))
    return out


def candidates(root: Node) -> dict[int, int]:
    """Those of ``subtree_hashes`` that may be a site's template, by id()."""
    hashes, sizes, out = subtree_hashes(root), measures(root), {}
    whole = sizes[id(root)][0]
    for node in _nodes(root):
        if node.tag not in CONTAINERS or node.drop or id(node) not in hashes:
            continue
        size, linked, words, blocks, article = sizes[id(node)]
        links = 2 * linked >= size
        passage = node.tag in OF_LINKS or (words >= PASSAGE_WORDS and not blocks)
        most = 2 * size > whole and (words >= SENTENCE_WORDS or node.tag != "div" or blocks)
        if not article and not most and (links or not passage):
            out[id(node)] = hashes[id(node)]
    return out


def subtree_hashes(root: Node) -> dict[int, int]:
    """64-bit hash by id() of every subtree that could be a site's template."""
    out: dict[int, int] = {}
    whole: dict[int, int] = {}
    for node in reversed(_nodes(root)):  # children before their parents
        parts = [node.tag, node.marks]
        for child in node.children:
            parts.append(f"<{whole[id(child)]}>" if isinstance(child, Node) else " ".join(child.split()))
        h = whole[id(node)] = xxhash.xxh3_64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        content = node.tag in ("#root", "html", "head", "body", "article", "main") or (node.in_article and node.tag in TEXT_ELEMENTS)
        if not content and node.tag not in VOID:
            out[id(node)] = h
    return out


def _nodes(root: Node) -> list[Node]:
    """Every element under ``root``, each after the one that holds it."""
    out, todo = [], [root]
    while todo:
        inner = [c for c in todo.pop().children if isinstance(c, Node)]
        out += inner
        todo += inner
    return out


def _length(node: Node) -> int:
    n, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                n += len(c)
            elif not c.drop:
                todo.append(c)
    return n


def _find(node: Node, tag: str) -> list[Node]:
    """Outermost elements of a tag that are not deleted, in their order."""
    out, todo = [], [node]
    while todo:
        at = todo.pop()
        if at is not node and at.tag == tag:
            out.append(at)
        else:
            todo += [c for c in reversed(at.children) if isinstance(c, Node) and not c.drop]
    return out


def main_text(page: str | None, templates=()) -> str:
    """Text of the article after deleting the subtrees whose hash is in ``templates``."""
    root = parse(page)
    if len(templates):
        found, known = candidates(root), set(templates)
        for node in _nodes(root):
            node.drop = node.drop or found.get(id(node)) in known
    return "\n".join(lines(root))


def _main(root: Node) -> Node:
    """The longest article; or the main element that holds it, if that holds more
    than the article besides; without either, the page."""
    articles, mains = _find(root, "article"), _find(root, "main")
    if not articles:
        return max(mains, key=_length) if mains else root
    best = max(articles, key=_length)
    around = [m for m in mains if any(x is best for x in _find(m, "article"))]
    return next((m for m in around if _length(m) > 2 * _length(best)), best)


def lines(root: Node) -> list[str]:
    """The blocks of the main text, in page order."""
    top = _main(root)
    blocks: list[list[str]] = [[]]

    todo: list = [*reversed(top.children)]  # text, elements, and None where a block begins or ends
    while todo:
        c = todo.pop()
        if c is None:
            blocks.append([])
        elif isinstance(c, str):
            blocks[-1].append(html.unescape(c))
        elif c.drop:
            blocks[-1].append(" ") if c.tag not in BLOCK else blocks.append([])
        elif c.tag == "br":
            blocks[-1].append(" ")
        elif c.tag in BLOCK:
            blocks.append([])
            todo += [None, *reversed(c.children)]
        else:
            todo += reversed(c.children)
    found = (" ".join("".join(b).split()) for b in blocks)
    return [x for x in found if x]


def page_core(root: Node) -> int:
    """64-bit hash of the longest blocks of a page's text: what its pages are told apart by."""
    longest = sorted(set(lines(root)), key=lambda x: (-len(x), x))[:LONGEST_BLOCKS]
    return xxhash.xxh3_64_intdigest("\x1f".join(longest).encode("utf-8", "surrogatepass")) - (1 << 63)


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _hash_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        cores, hashes = [], []
        for p in pdf["html"]:
            root = parse(p)
            hashes.append(sorted(set(candidates(root).values())))
            cores.append(page_core(root) if hashes[-1] else 0)
        yield pd.DataFrame({"host": pdf["host"], "page": pdf["page"], "core": cores, "hash": hashes}).explode("hash").dropna()


def page_key() -> Column:
    """64-bit hash of a page's markup."""
    return F.xxhash64(F.coalesce(F.col("html").cast("string"), F.lit("")))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, page, core, hash) of the subtrees of every page that could be templates."""
    rows = small_batches(pages).select(host(F.col("url")).alias("host"), page_key().alias("page"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(_hash_pages, "host string, page long, core long, hash long").distinct()


def templates(subtrees: DataFrame) -> DataFrame:
    """(host, hash) of the subtrees that recur on pages of the host with different text."""
    each = subtrees.select("host", "hash", "core").distinct()
    return each.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES).select("host", "hash")


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        text = [main_text(p, t if t is not None else ()) for p, t in zip(pdf["html"], pdf["templates"], strict=True)]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"), page_key().alias("page"))
    subtrees = written(page_subtrees(pages), "subtrees")
    known = written(templates(subtrees), "templates")
    longest = known.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    if longest <= MOST_LISTED:
        by, found = ["host"], known
    else:
        by, found = ["host", "page"], subtrees.join(broadcast_if(known, known.count()), ["host", "hash"])
    lists = written(found.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias("templates")), "template_lists")
    # a list counts as the numbers it holds
    joined = rows.join(broadcast_if(lists, lists.agg(F.sum(F.size("templates"))).first()[0] or 0), by, "left")
    return joined.select("page_id", "url", "html", "templates").mapInPandas(
        _extract, "page_id long, url string, text string, n_chars long")
