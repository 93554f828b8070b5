"""Main text of web pages: fixed boilerplate and site templates go, the article stays.

Each page is read once into its blocks of text.  With each block go the hashes of the element
subtrees (name, attributes, content) that hold it.  Per host, Spark counts on how many pages each
subtree of the page occurs, where pages with the same main text count once, so copies of an article
are no template.  Subtrees on a fixed number of pages of their host are deleted, however many pages
the host has: blocks inside them go.

Fixed rules also drop what is boilerplate by its name, class, id or role, and keep to ``article`` or ``main``
elements if a page has any.  Subtrees that these rules drop are counted like others, so they tell of
equal ones elsewhere.  Inside ``article`` or ``main``, headings, paragraphs, lists, tables and quotes
are the article itself and are not counted; other elements are.

Null pages and urls are empty.  Pages are told apart by their row, so repeated ids do no harm.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import pieces
from tidegrid.llm.url_filter import host_of
from tidegrid.session import cut_lineage

# Elements and words of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
DROPPED = frozenset("head nav header footer aside form dialog menu button select object canvas audio video map".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption hr address".split()) | INLINE
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice alert sidebar menu navbar nav "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies share sharing social related recommended newsletter "
    "subscribe subscription popup modal overlay login signin signup toolbar widget pagination pager search complementary contentinfo skip".split()
)

_TOKEN = re.compile(r"""<!--(?s:.*?)(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class TemplateParams:
    #: A subtree is part of a template if it is on so many different pages of its host.
    pages: int = 3


class _Element:
    __slots__ = ("name", "dropped", "main", "counted", "digest", "mark")

    def __init__(self, name: str, dropped: bool, main: bool, counted: bool, head: str) -> None:
        self.name, self.dropped, self.main, self.counted = name, dropped, main, counted
        self.digest = hashlib.blake2b(head.encode("utf-8", "surrogatepass"), digest_size=8)
        self.mark = 0


def _boilerplate(name: str, attributes: dict[str, str], inside_main: bool) -> bool:
    if name in DROPPED and not (name == "header" and inside_main):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if name in ("html", "body", "main", "article") and not BOILERPLATE & {"comment", "comments"} & set(_NAME.findall(attributes.get("class", "").lower())):
        return False
    return any(BOILERPLATE.intersection(_NAME.findall(attributes.get(k, "").lower())) for k in ("class", "id", "role"))


def read_blocks(page: str) -> tuple[list[tuple[str, list[int], bool]], list[int]]:
    """Blocks in page order: text, hashes of the subtrees around it, and whether it lies in an article or main element.

    Beside them the hashes of all counted subtrees of the page, also of those without a block.
    """
    stack: list[_Element] = []
    blocks: list[list] = []  # text parts, elements around, in main
    around: tuple[_Element, ...] = ()
    text: list[str] = []
    trees: set[int] = set()

    def end_block() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            blocks.append([joined, around, any(e.main for e in stack)])

    def pop() -> None:
        e = stack.pop()
        if e.counted:
            e.mark = int.from_bytes(e.digest.digest(), "big", signed=True)
            trees.add(e.mark)
        if stack:
            stack[-1].digest.update(e.digest.digest())

    at = 0
    skip_to: str | None = None
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        name = (m[2] or m[5] or "").lower()
        if skip_to:  # inside an element of raw text, only its end counts
            if not (name == skip_to and (m[1] or m[4])):
                continue
            skip_to, at = None, m.end()
            continue
        if m.start() > at:
            piece = html.unescape(page[at : m.start()])
            if stack:
                stack[-1].digest.update(piece.encode("utf-8", "surrogatepass"))
            if not (stack and stack[-1].dropped):
                text.append(piece)
        at = m.end()
        if not name:
            continue
        block = name not in INLINE and name != "br"
        if name == "br":
            text.append(" ")
        if block:
            end_block()
        if m[1] or m[4]:
            if any(e.name == name for e in stack):
                while stack[-1].name != name:
                    pop()
                pop()
        else:
            while stack and name in CLOSED_BY.get(stack[-1].name, ()):
                pop()
            if block and name in CLOSED_BY["p"] and any(e.name == "p" for e in stack) and not any(e.name in ("td", "th", "table", "button") for e in stack):
                while stack[-1].name != "p":
                    pop()
                pop()
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3] or m[6] or "")}
            parent = stack[-1] if stack else None
            inside = any(e.main for e in stack)
            main = name in ("article", "main") or attributes.get("role") == "main"
            if name not in VOID and not (m[3] or m[6] or "").rstrip().endswith("/"):
                counted = name not in INLINE and name not in ("html", "body") and not main and not (inside and name in PROSE)
                dropped = bool(parent and parent.dropped) or _boilerplate(name, attributes, inside)
                stack.append(_Element(name, dropped, main and not dropped, counted, f"{name}{sorted(attributes.items())}"))
                if name in RAW:
                    # Its content is no markup.
                    skip_to = name
                    stack.pop()
        if block:
            around = tuple(e for e in stack if e.counted)
    if not skip_to and at < len(page):
        if not (stack and stack[-1].dropped):
            text.append(html.unescape(page[at:]))
    end_block()
    while stack:
        pop()
    return [(t, [e.mark for e in elements], main) for t, elements, main in blocks], sorted(trees)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html", 1 << 20):
        out, digests, counted = [], [], []
        for page in batch.column("html").to_pylist():
            blocks, trees = read_blocks(page or "")
            if any(main for _, _, main in blocks):
                blocks = [b for b in blocks if b[2]]
            counted.append(trees)
            out.append([{"text": t, "inside": marks} for t, marks, _ in blocks])
            joined = "\n".join(t for t, _, _ in blocks).encode("utf-8", "surrogatepass")
            digests.append(int.from_bytes(hashlib.blake2b(joined, digest_size=8).digest(), "big", signed=True))
        kind = pa.list_(pa.struct([("text", pa.string()), ("inside", pa.list_(pa.int64()))]))
        rest = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(out, kind), pa.array(counted, pa.list_(pa.int64())), pa.array(digests, pa.int64())], [*rest, "blocks", "trees", "main"])


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), params: TemplateParams | None = None) -> DataFrame:
    """Columns ``keep`` and ``text``, the main text of ``html``, one line per block."""
    from pyspark.sql import types as T

    p = params or TemplateParams()
    taken = pages.select(*(F.col(f"`{c}`") for c in keep), host_of("url").alias("_host"), "html")
    block = T.StructType([T.StructField("text", T.StringType()), T.StructField("inside", T.ArrayType(T.LongType()))])
    fields = [taken.schema[c] for c in (*keep, "_host")] + [T.StructField("blocks", T.ArrayType(block)), T.StructField("trees", T.ArrayType(T.LongType())), T.StructField("main", T.LongType())]
    read = cut_lineage(taken.mapInArrow(_read, T.StructType(fields)).withColumn("_row", F.monotonically_increasing_id()))

    inside = read.select("_row", "_host", F.explode(F.array_distinct(F.flatten("blocks.inside"))).alias("tree"))
    trees = read.select("_host", F.explode("trees").alias("tree"), "main").distinct().groupBy("_host", "tree").agg(F.count("*").alias("on"))
    templates = trees.where(F.col("on") >= p.pages).select("_host", "tree")
    hit = inside.join(templates, ["_host", "tree"]).groupBy("_row").agg(F.collect_set("tree").alias("gone"))
    # Pages whose blocks lie in no counted subtree lose nothing; they are not shuffled.
    held = F.exists("blocks", lambda b: F.size(b["inside"]) > 0)
    open_pages = read.where(held).join(hit, "_row", "left").unionByName(read.where(~held), allowMissingColumns=True)
    rest = F.filter("blocks", lambda b: ~F.arrays_overlap(b["inside"], F.coalesce("gone", F.array().cast("array<bigint>"))))
    text = F.array_join(F.transform(rest, lambda b: b["text"]), "\n")
    return open_pages.select(*(F.col(f"`{c}`") for c in keep), text.alias("text"))
