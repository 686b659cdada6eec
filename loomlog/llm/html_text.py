"""Main text of web pages by equivalence-class template deduction.

Tokens are element openings, named by their path of containers, and blocks of text, named by
their container and content. Over the pages of a host, tokens with the same occurrence vector
(how often on each page) form an equivalence class. A vector is never gathered: two sums of
hashes of (page, occurrences) stand for it, which Spark combines before shuffling, so a host of
any size is no single group. Classes that enough pages share are valid; ordered by place and
nested by container they are the host's template. Blocks of text in a class with an element
are part of the template and go, and so do blocks of many pages, though not of all, whose class
is nested in that of a container in which most text varies. What varies remains in the template's slots: the slot that
holds most of it is the main one, and its text is extracted. A page without that slot is judged
by its own containers.

Elements that HTML itself sets apart (nav, header, footer, aside, form and the like) hold no
tokens. Class and id words are a last resort for varying text that no class can tell from an
article: comments, adverts and the like; inside of main content only words that mean nothing else. A
name says so only if all its words are such words or words of layout, so that `share-price` is prose.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import map_arrow, texts_of, written

#: Share of a host's pages that a class must occur on to belong to its template.
MIN_SHARE = 0.5
#: Distinct pages that a block of text must occur on to belong to a template.
MIN_PAGES = 3
#: As many for a block that is not on all pages of an element, at least, of a map of 64 places.
MANY_PAGES = 6

# Never gives back what it matched: a tag that does not end is found so in one pass over the rest.
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>|[!?/][^>]*+>)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)

# Elements of the HTML standard by their part in a text.
_RAW = {t: re.compile(rf"</{t}\b", re.I) for t in "script style noscript template textarea svg iframe title".split()}
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_LEFT_OUT = frozenset("head nav footer aside form button select menu dialog".split())
_HEADINGS = frozenset("p h1 h2 h3 h4 h5 h6".split())
_ENDS_P = _BLOCKS - {"body", "html"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_BOXES = frozenset("body div section td html center".split())
_HINTS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal navbar navigation nav newsletter notice notices popup promo related reply respond share sharing sidebar social sponsor sponsored subscribe widget".split())
_SURE_HINTS = frozenset("ad ads advert advertisement adverts comment comments consent cookie cookies disqus newsletter share sharing sidebar social sponsored subscribe".split())
#: Words beside which a hint still means a part of the page: `site-header`, but not `share-price`.
_LAYOUT = frozenset("area bar block bottom box btn button buttons class col column container content desktop float global group holder icon icons id inline inner item items js left level links list main mobile outer page panel post primary right row secondary section site slot sticky sub thread top unit user wrap wrapper".split())
_MAIN_HINTS = frozenset("article body content entry main post story text".split())


class Node:
    """An open block element; pid is a hash of its path, so that deep pages need no long paths."""

    __slots__ = ("chars", "depth", "inside", "label", "main", "out", "parent", "pid", "tag")

    def __init__(self, tag: str, label: str, parent: Node | None, out: bool, main: bool, slot: int | None):
        self.tag, self.label, self.parent, self.out, self.main, self.chars = tag, label, parent, out, main, 0
        self.pid = xxhash.xxh64_intdigest(label.encode("utf-8", "replace"), parent.pid if parent else 0) - (1 << 63)
        self.depth = parent.depth + 1 if parent else 0
        self.inside = self.pid == slot or parent is not None and parent.inside


def _node(tag: str, attributes: str, parent: Node | None, slot: int | None) -> Node:
    names = " ".join(x for m in _NAMES.findall(attributes) for x in m if x).lower() if "=" in attributes else ""
    words = set(re.split(r"[^a-z]+", names)) - {""} if names else ()
    # Only names that are made of hints and layout words alone say what a container is.
    told = {w for name in names.split() if (pieces := set(re.split(r"[^a-z]+", name)) - {""}) <= _HINTS | _LAYOUT for w in pieces}
    inside = bool(parent and parent.main)
    out = bool(parent and parent.out) or tag in _LEFT_OUT or tag == "header" and not inside
    if words and not out and tag not in ("html", "body", "article", "main"):
        out = bool(told & (_SURE_HINTS if inside else _HINTS)) and not words & _MAIN_HINTS or bool(told & {"comment", "comments"})
    return Node(tag, tag + "".join(f".{w}" for w in sorted(words)), parent, out, inside or tag in ("article", "main"), slot)


def walk(page: str, slot: int | None = None) -> Iterator[tuple[str, Node | None, str]]:
    """("open", node, ""), ("text", node, raw text), ("break", None, "") events of a page; broken nesting is repaired.

    Only block elements become nodes. An opening block ends an open paragraph; an end tag closes
    up to its opening, or nothing if that is not open. A tag, comment or raw element that does not
    end takes the rest of the page with it. Linear in the page.
    """
    stack: list[Node] = []
    open_: dict[str, int] = {}
    at, start = 0, page.find("<")

    def close() -> str:
        tag = stack.pop().tag
        open_[tag] -= 1
        return tag

    while start >= 0:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end, tag, closing, attributes = (end + 3 if end >= 0 else len(page)), "", "", ""
        elif m := _TAG.match(page, start):
            end, closing, tag, attributes = m.end(), m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
            if tag in _RAW and not closing:
                # The first end tag, which takes all up to the next bracket; without one the rest of the page is raw.
                m = _RAW[tag].search(page, end)
                end, tag = (page.find(">", m.end()) + 1 or len(page)) if m else len(page), ""
        elif page[start + 1 : start + 2].isalpha() or page[start + 1 : start + 2] in ("/", "!", "?"):
            end, tag, closing, attributes = len(page), "", "", ""
        else:
            start = page.find("<", start + 1)
            continue
        if start > at:
            yield "text", stack[-1] if stack else None, page[at:start]
        at, start = end, page.find("<", end)
        if tag == "br":
            yield "text", stack[-1] if stack else None, " "
        if tag not in _BLOCKS and tag not in _LEFT_OUT:
            continue
        if closing:
            if open_.get(tag):
                while close() != tag:
                    pass
                yield "break", None, ""
            continue
        if tag in _ENDS_P and stack and stack[-1].tag in _HEADINGS and (stack[-1].tag == "p" or tag == "p"):
            close()
        if tag in _SIBLINGS and stack and stack[-1].tag in _SIBLINGS[tag]:
            close()
        if tag == "body" and open_.get("head"):
            while close() != "head":
                pass
        yield "break", None, ""
        if tag not in _EMPTY:
            stack.append(_node(tag, attributes, stack[-1] if stack else None, slot))
            open_[tag] = open_.get(tag, 0) + 1
            yield "open", stack[-1], ""
    if at < len(page):
        yield "text", stack[-1] if stack else None, page[at:]


def blocks(page: str, slot: int | None = None) -> Iterator[tuple[Node | None, str | None]]:
    """(node, None) for each opening and (node, text) for each block of text, white space squeezed, that is not left out."""
    parts: list[str] = []
    holder: Node | None = None
    for kind, node, raw in walk(page, slot):
        if kind == "text":
            if node is None or not node.out:
                parts.append(raw)
                holder = node
            continue
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                yield holder, text
            parts.clear()
        if kind == "open" and not node.out:
            yield node, None
    text = " ".join(html.unescape("".join(parts)).split())
    if text:
        yield holder, text


def text_token(node: Node | None, text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), (node.pid if node else 0) & (1 << 64) - 1) - (1 << 63)


_TOKEN = ("pid", "parent", "label", "depth", "is_main", "text", "n", "place", "chars")


def page_tokens(page: str) -> list[list]:
    """Tokens of a page, as _TOKEN: text is zero for elements; n counts occurrences, place is the first one's; chars are of the text in it."""
    nodes: list[Node] = []
    texts: dict[int, list] = {}
    for place, (node, text) in enumerate(blocks(page)):
        if text is None:
            nodes.append(node)
            continue
        if node is not None:
            node.chars += len(text)
        token = texts.setdefault(text_token(node, text), [node.pid if node else 0, node.parent.pid if node and node.parent else 0, "", node.depth + 1 if node else 0, 0, 0, 0, place, 0])
        token[6] += 1
        token[8] += len(text)
    elements: dict[int, list] = {}
    for node in reversed(nodes):  # children before their containers
        if node.parent is not None:
            node.parent.chars += node.chars
    for place, node in enumerate(nodes):
        token = elements.setdefault(node.pid, [node.pid, node.parent.pid if node.parent else 0, node.label, node.depth, int(node.tag in ("article", "main")), 0, 0, place, 0])
        token[6] += 1
        token[8] += node.chars
    for key, token in texts.items():
        token[5] = key
    return [*elements.values(), *texts.values()]


def main_slot(elements: list[tuple[int, str, int, int, int, float]]) -> int | None:
    """The main slot among (pid, label, depth, is_main, chars, place): a main element with most text, else the deepest box with nearly all of it; of equal ones the first."""
    marked = [e for e in elements if e[3]]
    if marked:
        return max(marked, key=lambda e: (e[4], -e[2], -e[5]))[0]
    boxes = [e for e in elements if e[1].partition(".")[0] in _BOXES]
    if not boxes:
        return None
    most = max(e[4] for e in boxes)
    return max((e for e in boxes if 10 * e[4] >= 9 * most), key=lambda e: (e[2], -e[5]))[0]


def _own_slot(page: str) -> int | None:
    return main_slot([(t[0], t[2], t[3], t[4], t[8], t[7]) for t in page_tokens(page) if t[5] == 0])


def extract(page: str, slot: int | None, fixed: frozenset[int] = frozenset()) -> str:
    """Blocks of text in the slot's containers, one line each, without the template's."""
    kept, used = [], slot is None
    for node, text in blocks(page, slot):
        used = used or node is not None and node.inside
        if text is not None and (slot is None or node is not None and node.inside) and text_token(node, text) not in fixed:
            kept.append(text)
    if not used:
        return extract(page, _own_slot(page), fixed)
    return "\n".join(kept)


def _with_host(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url = F.col(f"`{url_col}`").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"), F.when(host != "", host).alias("host"))


_ARROW = {"pid": pa.int64(), "parent": pa.int64(), "label": pa.string(), "depth": pa.int32(), "is_main": pa.int32(), "text": pa.int64(), "n": pa.int64(), "place": pa.int64(), "chars": pa.int64()}


def templates(df: DataFrame, min_share: float = MIN_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The valid tokens of each host: (host, class_id, support, pid, parent, label, depth, is_main, text, place, chars, many).

    Tokens with one class_id share their occurrence vector. A class is valid if enough of the
    host's pages have it, and at least half that share of the distinct pages, which a 64-bit map
    tells well enough: copies of a page are no template. Pages without a host take no part.
    """
    pages = _with_host(df, id_col, url_col, html_col).filter("host is not null and html is not null")
    rows = pages.select("host", F.xxhash64("html").alias("content"), F.xxhash64("page_id", "url", "html").alias("page"), "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                heads = zip(*(part.column(i).to_pylist() for i in range(3)))
                found = [(*head, *token) for head, text in zip(heads, texts_of(part.column(3))) for token in page_tokens(text)]
                if found:
                    kinds = (pa.string(), pa.int64(), pa.int64(), *_ARROW.values())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=["host", "content", "page", *_TOKEN])

    tokens = map_arrow(rows, run, "host string, content long, page long, pid long, parent long, label string, depth int, is_main int, text long, n long, place long, chars long")
    seen = F.expr("bit_or(shiftleft(1L, cast(pmod(content, 64) as int)))")
    vector = lambda seed: F.sum(F.pmod(F.xxhash64("page", "n", F.lit(seed)), F.lit(1 << 31)))
    stats = tokens.groupBy("host", "pid", "parent", "label", "depth", "is_main", "text").agg(F.count("*").alias("support"), vector(1).alias("v1"), vector(2).alias("v2"), seen.alias("seen"), F.sum("place").alias("place"), F.sum("chars").alias("chars"))
    size = rows.groupBy("host").agg(F.count("*").alias("pages"), seen.alias("all_seen"))
    share = (F.col("support") >= min_share * F.col("pages")) & (2 * F.bit_count("seen") >= min_share * F.bit_count("all_seen"))
    valid = stats.join(size, "host").filter(share & ((F.col("text") == 0) | (F.bit_count("seen") >= MIN_PAGES)))
    many = (F.bit_count("seen") >= MANY_PAGES).alias("many")
    return valid.select("host", F.xxhash64("support", "v1", "v2").alias("class_id"), "support", "pid", "parent", "label", "depth", "is_main", "text", (F.col("place") / F.col("support")).alias("place"), "chars", many)


def nested(tokens: list[tuple]) -> tuple[int | None, list[int], dict[int, int | None]]:
    """Main slot, fixed blocks of text, and the class that each class is nested in, from one host's template.

    tokens: (class_id, pid, parent, label, depth, is_main, text, place, chars, many). A class hangs
    below the class of the container of its first and highest token. A block of text whose class
    has an element too is fixed; so is one on many pages whose class hangs below another, if most
    text of its container is in no class. What varies in a container is its text without the fixed blocks;
    where that is less than half of the main slot, nothing counts as fixed.
    """
    tokens = sorted(tokens, key=lambda t: (t[4], t[7], t[1], t[6]))
    elements = {t[1]: t for t in tokens if not t[6]}
    with_element = {t[0] for t in elements.values()}
    above: dict[int, int | None] = {}
    for t in tokens:
        if t[0] not in above:
            holder = elements.get(t[1] if t[6] else t[2])
            above[t[0]] = holder[0] if holder and holder[0] != t[0] else None
    shared = Counter()
    for t in tokens:
        if t[6]:
            shared[t[1]] += t[8]
    around = lambda t: t[9] and above[t[0]] is not None and 2 * shared[t[1]] <= elements[t[1]][8] if t[1] in elements else False
    fixed = [t for t in tokens if t[6] and (t[0] in with_element or around(t))]
    varying = {pid: t[8] for pid, t in elements.items()}
    for t in fixed:
        pid = t[1]
        while pid in varying:
            varying[pid] -= t[8]
            pid = elements[pid][2]
    slot = main_slot([(pid, t[3], t[4], t[5], varying[pid], t[7]) for pid, t in elements.items()])
    if slot is not None and 2 * varying[slot] < elements[slot][8]:  # versions of one article, not a template around many
        slot, fixed = main_slot([(pid, t[3], t[4], t[5], t[8], t[7]) for pid, t in elements.items()]), []
    return slot, [t[6] for t in fixed], above


def main_slots(classes: DataFrame) -> DataFrame:
    """(host, slot long, fixed array<long>): the main slot and the fixed blocks of text of each host's template.

    A host's template has as many tokens as its common layout, however many pages the host has.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slot, fixed, _ = nested(list(pdf[["class_id", "pid", "parent", "label", "depth", "is_main", "text", "place", "chars", "many"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "slot": pd.array([slot], "Int64"), "fixed": [fixed]})

    return classes.groupBy("host").applyInPandas(run, "host string, slot long, fixed array<long>")


def extract_main_text(df: DataFrame, min_share: float = MIN_SHARE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text), one row per input row.

    Null and empty pages, and pages without main text, give an empty text; a page whose url has
    no host is judged by itself. Repeated rows are extracted each. Bytes that are no UTF-8 count
    as U+FFFD.
    """
    # Written, so that the join has its own exchange and a hot host is split at run time.
    slots = written(main_slots(templates(df, min_share, id_col, url_col, html_col)))
    pages = _with_host(df, id_col, url_col, html_col).join(slots, "host", "left").select("page_id", "url", "html", "slot", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows = zip(texts_of(part.column(2)), part.column(3).to_pylist(), part.column(4).to_pylist())
                texts = [extract(page, slot if slot is not None else _own_slot(page), frozenset(fixed or ())) if page else "" for page, slot, fixed in rows]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return map_arrow(pages, run, "page_id long, url string, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
