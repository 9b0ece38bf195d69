"""Pages → node arrays: the one Python step of HTML extraction.

``parse_dom`` is an Arrow UDF called once per page. It returns the page text and the re-serialised
page once (as UTF-8 bytes) and a preorder array of element nodes that only hold byte offsets into
them, so every later step (axes, predicates, values) is native column work and each value costs a
slice of its own length.

``kids`` lists the nodes by parent and then in document order: a node's children are its slice from ``k0`` of ``kn``
numbers, and ``rank`` is its own place among its siblings.

Markup repair covers what pages rely on: implied ``html/head/body``, implied end tags of ``p``,
``li``, ``dt/dd``, ``option`` and table parts, implied ``tbody``/``tr``, stray end tags, and
re-opening of unclosed inline formatting in the next block.
"""

from __future__ import annotations

import sys
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need no installed copy of this package: the UDF carries its code with it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODE = T.StructType(
    [
        T.StructField("pre", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("last", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
    + [T.StructField(k, T.IntegerType()) for k in ("t0", "t1", "d0", "d1", "o0", "o1", "i0", "i1", "rank", "k0", "kn")]
)
DOM = T.StructType(
    [
        T.StructField("text", T.BinaryType()),
        T.StructField("html", T.BinaryType()),
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("kids", T.ArrayType(T.IntegerType())),
    ]
)
DOCUMENT = "#document"

# HTML element classes the repair rules speak about.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TEXT = frozenset("iframe noembed noframes noscript plaintext script style xmp".split())
ESCAPABLE_RAW_TEXT = frozenset("textarea title".split())
HEAD_ONLY = frozenset("base link meta noscript script style template title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section "
    "summary table ul".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SCOPE_END = frozenset("applet caption html table td th marquee object template".split())
# Start tag → open tags it ends, and where the search for them stops.
IMPLIED_END = {
    "li": (("li",), ("ol", "ul")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "thead": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"), ("table",)),
}
_TEXT_ESCAPE = str.maketrans(
    {"&": "&amp;", "'": "&#39;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "\r": "&#13;"}
)


class _Columns:
    """Arrow child columns of the node arrays of one batch."""

    def __init__(self):
        self.parent, self.last = [], []
        self.t0, self.t1, self.d0, self.d1 = [], [], [], []
        self.o0, self.o1, self.i0, self.i1 = [], [], [], []  # stay empty without markup
        self.tags, self.keys, self.values = [], [], []
        self.attr_offsets = [0]


def _size(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "replace"))


class _Page(HTMLParser):
    """One page appended to the batch columns; ``base`` is its first row there."""

    def __init__(self, cols: _Columns, with_html: bool):
        super().__init__(convert_charrefs=True)
        self.c, self.with_html = cols, with_html
        self.base = len(cols.tags)
        self.text, self.html = [], []
        self.t_len = self.h_len = 0
        self.stack: list[tuple[int, str]] = []
        self.formatting: list[tuple[int, str, list]] = []
        self.has_head = self.has_body = False
        self.verbatim = ""  # raw-text element whose content is being read
        self.with_text: set[int] = set()  # nodes that have a text child
        self.run = -1  # node whose first text child is still growing
        self._open(DOCUMENT, [])

    # -- tree events ----------------------------------------------------------------------------
    def _emit(self, s: str):
        self.html.append(s)
        self.h_len += _size(s)

    def _open(self, tag: str, attrs: list) -> int:
        c, at, stack = self.c, self.t_len, self.stack
        pre = len(c.tags) - self.base
        c.tags.append(tag)
        if attrs:
            seen = {}
            for k, v in attrs:
                if k not in seen:
                    seen[k] = "" if v is None else v
            c.keys.extend(seen)
            c.values.extend(seen.values())
        c.attr_offsets.append(len(c.keys))
        c.parent.append(stack[-1][0] if stack else -1)
        c.last.append(pre)
        c.t0.append(at)
        c.t1.append(at)
        c.d0.append(at)
        c.d1.append(at)
        if self.with_html:
            c.o0.append(self.h_len)
            if tag != DOCUMENT:
                shown = "".join([f' {k}="{v.translate(_TEXT_ESCAPE)}"' for k, v in seen.items()]) if attrs else ""
                self._emit(f"<{tag}{shown}/>" if tag in VOID else f"<{tag}{shown}>")
            c.o1.append(self.h_len)
            c.i0.append(self.h_len)
            c.i1.append(self.h_len)
        self.run = -1
        if tag not in VOID:
            stack.append((pre, tag))
        return pre

    def _close(self):
        pre, tag = self.stack.pop()
        row, c = self.base + pre, self.c
        c.last[row] = len(c.tags) - self.base - 1
        c.t1[row] = self.t_len
        if self.with_html:
            c.i1[row] = self.h_len
            if tag != DOCUMENT:
                self._emit(f"</{tag}>")
            c.o1[row] = self.h_len
        self.run = -1

    def _index(self, names, stops=()) -> int:
        """Stack position of the innermost open tag among ``names``, -1 if a stop tag is nearer."""
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][1]
            if tag in names:
                return k
            if tag in stops:
                return -1
        return -1

    def _pop_to(self, k: int):
        while len(self.stack) > k:
            self._close()

    # -- implied structure ----------------------------------------------------------------------
    def _ensure_html(self):
        if len(self.stack) == 1:
            self._open("html", [])

    def _ensure_head(self):
        self._ensure_html()
        if not self.has_head:
            self.has_head = True
            self._open("head", [])

    def _ensure_body(self):
        if self.has_body:
            return
        self._ensure_head()
        self._pop_to(2)
        self.has_body = True
        self._open("body", [])

    def _reopen_formatting(self):
        if not self.formatting:
            return
        open_nodes = {pre for pre, _ in self.stack}
        for n, (pre, tag, attrs) in enumerate(self.formatting):
            if pre not in open_nodes:
                self.formatting[n] = (self._open(tag, attrs), tag, attrs)

    def _place(self, tag: str):
        """Close and open whatever ``tag`` implies before it is added."""
        if not self.has_body and tag in HEAD_ONLY and (len(self.stack) < 3 or self.stack[-1][1] == "head"):
            self._ensure_head()
            return
        self._ensure_body()
        if tag in CLOSES_P:
            k = self._index(("p",), SCOPE_END)
            if k > 0:
                self._pop_to(k)
        if tag in IMPLIED_END:
            names, stops = IMPLIED_END[tag]
            k = self._index(names, stops)
            while k > 0:
                self._pop_to(k)
                k = self._index(names, stops)
        if tag in ("td", "th", "tr") and self._index(("table",)) > 0:
            if tag != "tr" and self._index(("tr",), ("table",)) < 0:
                self._place("tr")
                self._open("tr", [])
            elif tag == "tr" and self.stack[-1][1] == "table":
                self._open("tbody", [])
        if tag[:1] == "h" and tag[1:].isdigit() and self.stack[-1][1][1:].isdigit() and self.stack[-1][1][0] == "h":
            self._close()

    # -- HTMLParser callbacks -------------------------------------------------------------------
    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in RAW_TEXT or tag in ESCAPABLE_RAW_TEXT:
            if self._index(("svg", "math")) < 0:
                self.verbatim = tag
                self.set_cdata_mode(tag)

    def _start(self, tag, attrs):
        if tag == "html" or tag == "body" and self.has_body or tag == "head" and self.has_head:
            if tag == "html" and len(self.stack) == 1:
                self._open(tag, attrs)
            return
        if tag == "head":
            self._ensure_html()
            self.has_head = True
            self._open(tag, attrs)
            return
        if tag == "body":
            self._ensure_head()
            self._pop_to(2)
            self.has_body = True
            self._open(tag, attrs)
            return
        self._place(tag)
        if tag in FORMATTING:
            if tag == "a" and any(t == "a" for _, t, _ in self.formatting):
                self.handle_endtag("a")
            self._reopen_formatting()
            same = [n for n, (_, t, a) in enumerate(self.formatting) if t == tag and a == attrs]
            if len(same) >= 3:
                del self.formatting[same[0]]
            self.formatting.append((self._open(tag, attrs), tag, attrs))
            return
        if tag not in CLOSES_P and tag not in IMPLIED_END and self.has_body:
            self._reopen_formatting()
        self._open(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._index(("svg", "math")) > 0 and self.stack[-1][1] == tag:
            self._close()

    def handle_endtag(self, tag):
        self.verbatim = ""
        if tag in ("html", "body"):
            return
        if tag == "head":
            k = self._index(("head",))
            if k > 0:
                self._pop_to(k)
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        stops = () if tag in ("table", "caption", "td", "th", "template") else SCOPE_END
        k = self._index((tag,), stops)
        if k < 0:
            if tag == "p":
                self._place("p")
                self._open("p", [])
                self._close()
            if tag in FORMATTING:
                self._forget(tag)
            return
        self._pop_to(k)
        if tag in FORMATTING:
            self._forget(tag)

    def _forget(self, tag):
        for n in range(len(self.formatting) - 1, -1, -1):
            if self.formatting[n][1] == tag:
                del self.formatting[n]
                return

    def handle_data(self, data):
        if self.verbatim in ESCAPABLE_RAW_TEXT and self.stack[-1][1] == self.verbatim:
            data = unescape(data)
        raw = self.stack[-1][1] in RAW_TEXT
        if not raw:
            if not self.has_body:
                if not data.strip():
                    if self.stack[-1][1] in (DOCUMENT, "html") and not self.has_head:
                        return
                elif self.stack[-1][1] not in HEAD_ONLY:
                    self._ensure_body()
            if self.has_body:
                self._reopen_formatting()
        pre = self.stack[-1][0]
        start = self.t_len
        self.text.append(data)
        self.t_len = end = start + _size(data)
        if pre not in self.with_text:
            self.with_text.add(pre)
            self.c.d0[self.base + pre] = start
            self.c.d1[self.base + pre] = end
            self.run = pre
        elif self.run == pre:
            self.c.d1[self.base + pre] = end
        if self.with_html:
            self._emit(data if raw else data.translate(_TEXT_ESCAPE))

    def handle_comment(self, data):
        if self.with_html:
            self._emit(f"<!--{data}-->")
        self.run = -1

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)  # "<![if …]>" is a comment, never an error

    def handle_decl(self, decl):
        if self.with_html and decl.lower().startswith("doctype") and len(self.stack) == 1:
            self._emit("<!DOCTYPE " + decl[7:].strip().lower() + ">")

    def finish(self):
        self.close()
        if self.cdata_elem and self.rawdata:  # raw text that is never closed goes to the end
            self.handle_data(self.rawdata)
        self._ensure_body()
        self._pop_to(0)
        return "".join(self.text).encode("utf-8", "replace"), "".join(self.html).encode("utf-8", "replace")


def _family(ints: dict, starts: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``kids`` and where each page's begin; adds rank, k0 and kn to the node columns. ``starts``: first row of each node's page."""
    parent = np.array(ints["parent"], dtype=np.int32)
    child = np.flatnonzero(parent >= 0).astype(np.int32)
    above = parent[child] + starts[child]
    order = child[np.argsort(above, kind="stable")]
    kn = np.bincount(above, minlength=len(parent)).astype(np.int32)
    first = (np.cumsum(kn) - kn).astype(np.int32)
    per_page = np.concatenate([[0], np.cumsum(parent >= 0)])[offsets].astype(np.int32)
    rank = np.zeros(len(parent), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32) - first[parent[order] + starts[order]]
    base = np.repeat(per_page[:-1], np.diff(offsets))
    ints.update(rank=rank, kn=kn, k0=first - base)
    return pa.array(order - starts[order], pa.int32()), pa.array(per_page, pa.int32())


def _parse_batch(bodies: pa.Array, with_html: bool) -> pa.Array:
    cols, texts, htmls, offsets, valid = _Columns(), [], [], [0], []
    # as bytes: one invalid sequence must not end the job
    for body in bodies.cast(pa.binary()).to_pylist():
        valid.append(body is not None)
        if body is None:
            texts.append(None)
            htmls.append(None)
        else:
            page = _Page(cols, with_html)
            page.feed(body.decode("utf-8", "replace"))
            text, html = page.finish()
            texts.append(text)
            htmls.append(html)
        offsets.append(len(cols.tags))
    attrs = pa.MapArray.from_arrays(
        pa.array(cols.attr_offsets, pa.int32()), pa.array(cols.keys, pa.string()), pa.array(cols.values, pa.string())
    )
    total = len(cols.tags)
    starts = np.repeat(np.array(offsets[:-1], dtype=np.int32), np.diff(np.array(offsets, dtype=np.int32)))
    none = np.zeros(total, dtype=np.int32)
    ints = {k: getattr(cols, k) or none for k in ("parent", "last", "t0", "t1", "d0", "d1", "o0", "o1", "i0", "i1")}
    ints["pre"] = np.arange(total, dtype=np.int32) - starts
    kids, kid_offsets = _family(ints, starts, np.array(offsets, dtype=np.int32))
    names = NODE.names
    children = [
        pa.array(cols.tags, pa.string()) if k == "tag" else attrs if k == "attrs" else pa.array(ints[k], pa.int32())
        for k in names
    ]
    nodes = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(children, names))
    return pa.StructArray.from_arrays(
        [pa.array(texts, pa.binary()), pa.array(htmls, pa.binary()), nodes, pa.ListArray.from_arrays(kid_offsets, kids)],
        ["text", "html", "nodes", "kids"],
        mask=pa.array([not v for v in valid], pa.bool_()),
    )


@F.arrow_udf(DOM)
def _dom_with_html(body: pa.Array) -> pa.Array:
    return _parse_batch(body, True)


@F.arrow_udf(DOM)
def _dom_text_only(body: pa.Array) -> pa.Array:
    return _parse_batch(body, False)


_dom_with_html = _dom_with_html.asNondeterministic()
_dom_text_only = _dom_text_only.asNondeterministic()


def parse_dom(body: Column, with_html: bool = True) -> Column:
    """Node array of a page. Skip ``with_html`` when no rule reads markup back.

    Declared non-deterministic so that the optimizer never evaluates it twice for one row.
    """
    return (_dom_with_html if with_html else _dom_text_only)(body)


def _cut(data: Column, start: Column, end: Column) -> Column:
    return F.substring(data, start + 1, end - start).cast("string")


def node_text(dom: Column, node: Column) -> Column:
    """All descendant text."""
    return _cut(dom["text"], node["t0"], node["t1"])


def node_direct_text(dom: Column, node: Column) -> Column:
    """The first text child."""
    return _cut(dom["text"], node["d0"], node["d1"])


def node_inner_html(dom: Column, node: Column) -> Column:
    return _cut(dom["html"], node["i0"], node["i1"])


def node_outer_html(dom: Column, node: Column) -> Column:
    return _cut(dom["html"], node["o0"], node["o1"])


def node_attr(node: Column, name: str) -> Column:
    return F.try_element_at(node["attrs"], F.lit(name))
