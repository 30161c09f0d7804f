"""Main text of web pages, with site templates removed.

Each page is read once as a stream of tags and text that keeps the open elements.
Elements that are never article text (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are known by their tag, role, class
or id. Classes and ids tell nothing of headings and of elements within a line, and ids
nothing of a ``section`` (but for reader comments): those are anchors of the text. If a page marks its article (``article``, ``main``, ``role=main``), only that is
text.

Site templates are found by counting: every element subtree that could be a template
has a hash of its tag, its text and its children's hashes; Spark counts, per host, on how many different pages
(by a digest of the html, so copies of one page count once) each hash occurs. Subtrees
on at least ``min_pages`` pages are deleted if that is a share of ``min_share`` of the
host's pages or at least ``many_pages`` pages, so that the bar does not grow with the
host. Paragraphs, headings, list items and cells inside a marked article are mostly its
own words: for them both counts are ``STRICTER`` times as high. What a page loses is
found by joining its hashes to the host's recurring ones by host and hash, and goes back
to the page by host and digest; Spark broadcasts what is under a size limit and otherwise
joins by shuffling, splitting hot keys.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined by an empty line. Null or empty html gives an empty text; a page
without host has no templates. Repeated rows are extracted each by itself. Only the
id, url and html columns are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.shared import arrow_schema, written
from spanlake.operators.common import MAX_BROADCAST_BYTES, broadcast_if_small, explode_rows

MIN_PAGES = 5
MIN_SHARE = 0.3
MANY_PAGES = 20
STRICTER = 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# The content of these is no text, whatever it looks like.
RAW = frozenset("script style title textarea noscript iframe template svg math object canvas select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead caption figcaption".split())
NEVER = frozenset("nav footer aside form button menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# An element of these begins its own kind anew and ends an open one of it.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
            "th": ("tr", "table"), "option": ("select",)}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:\w*nav|nav(?:bar|igation)|\w*menu|\w*footer|\w*sidebar|ads?|ad(?:box|slot|unit|wrap|container)"
    r"|advert\w*|adsense|\w*banner|sponsor\w*|promo\w*|cookie\w*|consent\w*|gdpr|notices?|notification\w*|popup\w*"
    r"|modal|overlay|newsletter\w*|subscri\w+|share\w*|sharing|social\w*|related\w*|recommend\w*|breadcrumbs?"
    r"|pagination|pager|widget\w*|login\w*|signup\w*|search\w*|toolbar|masthead|skip)(?:$|[\s_-])")
COMMENTS = re.compile(
    r"(?:^|[\s_-])(?:(?:user|reader)?comments?(?:list|section|area|box|thread|form)?|respond|reply|replies|disqus)(?:$|[\s_-])")
HEADER = re.compile(r"(?:^|[\s_-])(?<!post[_-])(?<!article[_-])(?<!entry[_-])(?<!story[_-])(?<!content[_-])"
                    r"(?:header|topbar)(?:$|[\s_-])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element:
    __slots__ = ("tag", "block", "candidate", "main", "signs")

    def __init__(self, tag, block, candidate, main):
        self.tag, self.block, self.candidate, self.main = tag, block, candidate, main
        self.signs = [tag]  # its tag, then texts and children's hashes in order


class Page:
    """Reads one page. ``templates`` are hashes of subtrees to delete; ``hashes``
    collects those of all candidates, the odd ones of text blocks in an article."""

    def __init__(self, templates=frozenset()):
        self.templates, self.hashes = templates, set()
        self.blocks: list[tuple[str, bool]] = []
        self.parts: list[str] = []
        self.open: list[Element] = []
        self.opened = Counter()  # open elements of each tag
        self.around = [Element("", 0, 0, 0)]  # those that are not within a line; the first is the page
        self.in_main = 0
        self.skipped = None  # (number of open elements outside, is it for comments)

    def flush(self):
        if self.parts:
            raw = "".join(self.parts)
            self.parts = []
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                self.blocks.append((text, self.in_main > 0))
                self.around[-1].signs.append(text)

    def text(self, raw: str):
        if raw and self.skipped is None:
            self.parts.append(raw)

    def close(self):
        e = self.open.pop()
        self.opened[e.tag] -= 1
        sign = 0
        if e.tag not in INLINE:
            self.flush()
            self.around.pop()
            sign = xxhash.xxh64_intdigest("\x1f".join(e.signs).encode("utf-8", "replace"))
            self.around[-1].signs.append(f"<{sign:x}")
        if self.skipped is not None:
            if len(self.open) <= self.skipped[0]:
                self.skipped = None
        elif e.candidate:
            if len(self.blocks) > e.block:
                sign = (sign >> 1 << 1) + (e.candidate > 1) - (1 << 63)
                self.hashes.add(sign)
                if sign in self.templates:
                    del self.blocks[e.block:]
        self.in_main -= e.main

    def close_to(self, n: int):
        while len(self.open) > n:
            self.close()

    def start(self, tag: str, raw_attrs: str):
        if tag not in INLINE:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1) if self.opened["p"] else ():  # a block ends an open paragraph
                if self.open[i].tag == "p":
                    self.close_to(i)
                    break
                if self.open[i].tag not in INLINE:
                    break
        if tag in SIBLINGS and self.opened[tag]:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == tag:
                    self.close_to(i)
                if i >= len(self.open) or self.open[i].tag in SIBLINGS[tag]:
                    break
        attrs = {}
        if raw_attrs and not raw_attrs.isspace():
            attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw_attrs)}
        role = attrs.get("role", "").lower()
        names = comment_names = ""
        if attrs and tag not in INLINE and tag not in HEADINGS:
            comment_names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
            names = attrs.get("class", "").lower() if tag == "section" else comment_names
        article = tag in ("article", "main") or role in ("main", "article")
        about_comments = bool(comment_names) and COMMENTS.search(comment_names) is not None
        if article and self.skipped is not None and not self.skipped[1] and not about_comments:
            self.skipped = None  # what wraps the article, or was never closed, is no menu
        if self.skipped is None and (about_comments or not article) and tag not in ("html", "body"):
            if (tag in NEVER or about_comments or role in ROLES or "hidden" in attrs
                    or attrs.get("aria-hidden") == "true" or names and NAMES.search(names)
                    or not self.in_main and (tag == "header" or names and HEADER.search(names))
                    or "style" in attrs and HIDDEN.search(attrs["style"])):
                self.flush()
                self.skipped = len(self.open), about_comments
        main = int(article and self.skipped is None)
        candidate = int(self.skipped is None and not article and tag not in INLINE and tag not in ("html", "body"))
        if self.in_main and tag in TEXT_BLOCKS:
            candidate *= 2
        e = Element(tag, len(self.blocks), candidate, main)
        self.open.append(e)
        self.opened[tag] += 1
        if tag not in INLINE:
            self.around.append(e)
        self.in_main += main

    def end(self, tag: str):
        if not self.opened[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self.close_to(i)
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return  # never opened here

    def read(self, html: str) -> Page:
        at = 0
        while m := TOKEN.search(html, at):
            self.text(html[at:m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"] or m["end2"]:
                self.end(tag)
            elif tag in RAW:
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = closing.end() if closing else len(html)
            elif tag == "br":
                self.text(" ")
            elif tag in VOID:
                if tag == "hr":
                    self.flush()
            else:
                self.start(tag, m["attrs"] or m["attrs2"] or "")
        self.text(html[at:])
        self.close_to(0)
        self.flush()
        return self

    def main_text(self) -> str:
        own = [t for t, main in self.blocks if main]
        return "\n\n".join(own or [t for t, _ in self.blocks])


CANDIDATES = T.StructType([T.StructField("host", T.StringType()), T.StructField("page", T.LongType()),
                           T.StructField("subtrees", T.ArrayType(T.LongType()))])


def _candidates(batches):
    schema = arrow_schema(CANDIDATES)
    for batch in batches:
        found = [list(Page().read(html.as_py()).hashes) for html in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, schema.field("subtrees").type)],
                                         schema=schema)


HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), HOST, 1))


def site_templates(found: DataFrame, *, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                   many_pages: int = MANY_PAGES) -> DataFrame:
    """``(host, subtree)``: the hashes of each host's recurring subtrees. ``found`` has
    the host, the digest and the hashes of each page."""
    each = explode_rows(found, F.col("subtrees"), ["host", "page"], "subtree")
    counts = each.groupBy("host", "subtree").agg(F.count_distinct("page").alias("n"))
    counts = written(counts.where(F.col("n") >= min_pages), "subtrees")
    sizes = found.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    times = F.when(F.col("subtree").bitwiseAND(1) == 1, STRICTER).otherwise(1)
    often = (F.col("n") >= min_share * F.col("pages")) | (F.col("n") >= many_pages * times)
    return counts.join(sizes, "host").where((F.col("n") >= min_pages * times) & often).select("host", "subtree")


def main_texts(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES,
               max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per page: id, url, text."""
    html = F.coalesce(html_col, F.lit(""))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"),
                          host_of(url_col).alias("host"), F.xxhash64(html).alias("page"))
    found = written(source.where("host != ''").select("host", "page", "html").mapInArrow(_candidates, CANDIDATES), "candidates")
    recurring = broadcast_if_small(site_templates(found, min_pages=min_pages, min_share=min_share, many_pages=many_pages),
                                   "recurring", max_broadcast_bytes)
    lost = (explode_rows(found, F.col("subtrees"), ["host", "page"], "subtree").join(recurring, ["host", "subtree"])
            .groupBy("host", "page").agg(F.collect_set("subtree").alias("templates")))
    templates = broadcast_if_small(lost, "templates", max_broadcast_bytes)
    schema = T.StructType([T.StructField(id_col, source.schema[0].dataType), T.StructField(url_col, T.StringType()),
                           T.StructField("text", T.StringType())])
    arrow = arrow_schema(schema)

    def extract(batches):
        for batch in batches:
            texts = [Page(frozenset(t.as_py() or ())).read(h.as_py()).main_text()
                     for h, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=arrow)

    return (source.join(templates, ["host", "page"], "left").select("id", "url", "html", "templates")
            .mapInArrow(extract, schema))
