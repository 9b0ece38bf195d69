"""Golden pages for the DOM, selectors and field rules."""

import html as stdhtml

import pytest
from pyspark.sql import functions as F

from webtables.functions import dom as D
from webtables.functions import select as S
from webtables.functions.entities import unescape
from webtables.functions.text import compile_regex, to_int, trim_ws
from webtables.functions.urls import resolve_url, url_error
from webtables.operators.html import extract_html
from webtables.plans.spec import Extract, Field

PAGE = """<html><body>
<div id="head"><h1> Ada &amp; Co </h1><span class="n big">12</span></div>
<div class="box card"><a class="t" href="/p/1?x=1#f"> One </a><i>a1</i><i>b2 c3</i><em></em></div>
<div class="card"><a href="../two">Two</a><i>none</i></div>
<script>var total = 41; var s = "<p>no</p>";</script>
</body></html>"""


def run(spark, body, spec, url="https://h.example/a/b/c.html"):
    df = spark.createDataFrame([(1, url, body)], "page_id long, url string, html string")
    return extract_html(df, spec).collect()[0].asDict(recursive=True)


def nodes(spark, body):
    df = spark.createDataFrame([(body,)], "html string").select(D.parse_dom(F.col("html")).alias("d"))
    r = df.select("d.nodes", F.col("d.text").cast("string").alias("t"), F.col("d.html").cast("string").alias("h")).collect()[0]
    return r


def tree(r):
    """tag path of every node."""
    out = []
    for n in r.nodes:
        path, k = [], n
        while k.parent >= 0:
            path.append(k.tag)
            k = r.nodes[k.parent]
        out.append("/".join(reversed(path)))
    return out[1:]


def test_every_field_rule(spark):
    spec = Extract(
        scope=S.descendant("div", S.has_class("card")),
        meta={"total": Field(S.descendant("script"), regex=r"total = (\d+)", type="int")},
        page={"head": Field(S.descendant("h1"), trim=True), "raw": Field(S.descendant("h1"))},
        fields={
            "name": Field(S.descendant("a"), trim=True),
            "url": Field(S.child("a"), attr="href", resolve_url=True),
            "codes": Field(S.child("i"), regex=r"([a-z])\d", multiple=True),
            "nums": Field(S.child("i"), regex=r"\d", multiple=True, type="int"),
            "whole": Field(S.child("i"), regex=r"[a-z]\d"),
            "empty": Field(S.child("em")),
            "dflt": Field(S.child("b"), default="d"),
            "idflt": Field(S.child("b"), type="int", default="7"),
            "inner": Field(S.child("a"), attr="html"),
            "outer": Field(S.child("a"), attr="outer_html"),
            "cls": Field(S.self_node(), attr="class"),
            "none": Field(None),
        },
    )
    r = run(spark, PAGE, spec)
    assert r["error"] is None and r["meta"] == {"total": 41}
    assert r["page"] == {"head": "Ada & Co", "raw": " Ada & Co "}
    one, two = r["items"]
    assert one == {
        "name": "One", "url": "https://h.example/p/1?x=1#f", "codes": ["a", "b", "c"], "nums": ["1", "2", "3"], "whole": "a1",
        "empty": None, "dflt": "d", "idflt": 7, "inner": " One ", "outer": '<a class="t" href="/p/1?x=1#f"> One </a>', "cls": "box card", "none": None,
    }
    # Only the first node is tried for a single field, and a list without values is empty.
    assert two["codes"] == [] and two["whole"] is None and two["url"] == "https://h.example/a/two"


def test_skip_error_and_group_rules(spark):
    card = S.descendant("div", S.has_class("card"))
    skipped = run(spark, PAGE, Extract(scope=card, fields={"n": Field(S.child("i"), regex=r"\d", on_missing="skip_item")}))
    assert [i["n"] for i in skipped["items"]] == ["1"]
    required = run(spark, PAGE, Extract(scope=card, fields={"n": Field(S.child("i"), regex=r"\d", required=True)}))
    assert required["items"] is None and required["error"] == 'field "n" is missing'
    bad_int = run(spark, PAGE, Extract(scope=card, fields={"n": Field(S.child("a"), type="int", trim=True)}))
    assert bad_int["error"] == 'field "n": convert "One" to int'
    # An error beats a skip, and the alphabetically first field is reported.
    both = run(spark, PAGE, Extract(scope=card, fields={"z": Field(S.child("a"), type="int"), "b": Field(S.child("q"), on_missing="skip_item"), "c": Field(S.child("a"), type="int", trim=True)}))
    assert both["error"].startswith('field "c"')
    # A group that does not exist matters only once something matches.
    assert run(spark, PAGE, Extract(fields={"x": Field(S.descendant("h1"), regex="zzz", group=3)}))["error"] is None
    assert "out of range" in run(spark, PAGE, Extract(fields={"x": Field(S.descendant("h1"), regex="A(d)a", group=3)}))["error"]
    meta = run(spark, PAGE, Extract(meta={"x": Field(S.descendant("q"), on_missing="skip_item")}, fields={"a": Field(S.descendant("h1"))}))
    assert meta["error"] == 'meta "x" is missing'
    page = run(spark, PAGE, Extract(page={"x": Field(S.descendant("q"), on_missing="skip_item")}, fields={"a": Field(S.descendant("h1"))}))
    assert page["error"] is None and page["page"] is None and len(page["items"]) == 1


def test_decoded_after_the_regex(spark):
    body = "<p title='a &amp;lt; b'>x &amp;amp; y &amp;quot;</p>"
    r = run(spark, body, Extract(fields={"t": Field(S.descendant("p"), attr="title"), "p": Field(S.descendant("p"), regex=r"&amp;|&quot;", multiple=True)}))
    assert r["items"] == [{"t": "a < b", "p": ["&", '"']}]


def test_selectors(spark):
    body = """<ul><li class="a">1<b>x</b></li><li id="p9">2</li></ul><ul><li>3</li><li class="b a">4 <a href="/q">go</a></li></ul>
    <dl><dt>Label</dt><dd>v1</dd><dt>  Other
    label </dt><dd>v2</dd></dl>"""

    def texts(sel):
        got = run(spark, body, Extract(fields={"v": Field(sel, multiple=True, trim=True)}))
        assert got["error"] is None
        return got["items"][0]["v"]

    li = S.descendant("li")
    assert texts(li) == ["1x", "2", "3", "4 go"]
    assert texts(li.nth(1)) == ["1x", "3"] and texts(li.nth(-1)) == ["2", "4 go"] and texts(li.nth(2)) == ["2", "4 go"]
    assert texts(li.first()) == ["1x"] and texts(li.last()) == ["4 go"]
    assert texts(li.last().descendant("a")) == ["go"]
    assert texts(S.descendant("li", S.has_class("a"))) == ["1x", "4 go"]
    assert texts(S.descendant("li", S.attr_starts_with("id", "p"))) == ["2"]
    assert texts(S.descendant("li", S.has_child("a"))) == ["4 go"]
    assert texts(S.descendant("li", S.not_(S.has_attr("class")))) == ["2", "3"]
    assert texts(S.descendant("li", S.any_of(S.has_attr("id"), S.has_descendant("b")))) == ["1x", "2"]
    assert texts(S.descendant("*", S.text_is("Other label")).following_sibling("*").nth(1)) == ["v2"]
    assert texts(S.descendant("dt", S.direct_text_contains("Label")).following_sibling("dd").nth(1)) == ["v1"]
    assert texts(S.descendant("b").parent()) == ["1x"]
    assert texts(S.descendant("ul").descendant("li")) == ["1x", "2", "3", "4 go"]
    # Nested contexts give each node once, in document order.
    assert texts(S.descendant("*").descendant("b")) == ["x"]


@pytest.mark.parametrize(
    "body, want",
    [
        ("<p>a<p>b", ["html", "html/head", "html/body", "html/body/p", "html/body/p"]),
        ("<ul><li>a<li>b</ul>c", ["html", "html/head", "html/body", "html/body/ul", "html/body/ul/li", "html/body/ul/li"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["html", "html/head", "html/body"] + ["html/body/table" + s for s in ("", "/tbody", "/tbody/tr", "/tbody/tr/td", "/tbody/tr/td", "/tbody/tr", "/tbody/tr/td")]),
        ("<title>t</title><p>x", ["html", "html/head", "html/head/title", "html/body", "html/body/p"]),
        ("<p><b>x<p>y</b>z", ["html", "html/head", "html/body", "html/body/p", "html/body/p/b", "html/body/p", "html/body/p/b"]),
        ("</p>", ["html", "html/head", "html/body", "html/body/p"]),
        ("<p>a<div>b</div>c", ["html", "html/head", "html/body", "html/body/p", "html/body/div"]),
        ("<select><option>a<option>b</select>", ["html", "html/head", "html/body"] + ["html/body/select" + s for s in ("", "/option", "/option")]),
        ("", ["html", "html/head", "html/body"]),
    ],
)
def test_markup_repair(spark, body, want):
    assert tree(nodes(spark, body)) == want


def test_text_and_markup_offsets(spark):
    r = nodes(spark, "<p class='q\"'>ü <b>b</b><br>&amp;é</p><!-- c --><script>a<b</script>")
    assert r.t == "ü b&éa<b"
    assert r.h.startswith('<html><head></head><body><p class="q&#34;">ü <b>b</b><br/>&amp;é</p><!-- c --><script>a<b</script>')
    for n in r.nodes:
        assert r.nodes[n.pre] is not None and n.last >= n.pre and n.o0 <= n.i0 <= n.i1 <= n.o1


def test_null_body_stays_null(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "<p>x</p>")], "page_id long, url string, html string")
    r = {x.page_id: x for x in extract_html(df, Extract(fields={"p": Field(S.descendant("p"))})).collect()}
    assert r[1]["items"] is None and r[1]["error"] is None and r[2]["items"][0].p == "x"


ENTITIES = ["a &amp;lt; b", "&amp;", "x&ampy", "&#65;&#x42;&#128;", "&notit; &hearts;", "&nosuch; &", "AT&T", "&copy2024", "&NotEqualTilde;&#0;", "&&amp;&", "&#xD800;", "&#x110000;", "&frac12;&AMP;&lt", "é&eacute;"]


def test_unescape_equals_the_standard_table(spark):
    df = spark.createDataFrame([(s,) for s in ENTITIES], "s string")
    got = [r[0] for r in df.select(unescape(F.col("s"))).collect()]
    assert got == [stdhtml.unescape(s) for s in ENTITIES]


# RFC 3986 section 5.4 reference cases.
BASE = "http://a/b/c/d;p?q"
RFC = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g",
    "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s",
    ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g",
    "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g", "g/../h": "http://a/b/c/h", "HTTP://X/é": "http://X/%C3%A9",
}


def test_resolve_url(spark):
    df = spark.createDataFrame(list(RFC.items()), "raw string, want string")
    for r in df.select("raw", "want", resolve_url(F.lit(BASE), F.col("raw")).alias("got"), url_error(F.col("raw")).alias("err")).collect():
        assert (r.got, r.err) == (r.want, None), r.raw
    bad = spark.createDataFrame([("a:b c",), ("%zz",), (":x",), ("1a:b",), ("a\nb",)], "raw string")
    assert [r[0] is None for r in bad.select(url_error(F.col("raw"))).collect()] == [True, False, False, False, False]


def test_regex_dialect(spark):
    assert compile_regex(r"(a)(?:b)(?P<n>c)") == (r"(?d)(a)(?:b)(?<n>c)", 2)
    for bad in (r"(?=a)", r"(?<!a)", r"(a)\1"):
        with pytest.raises(ValueError):
            compile_regex(bad)
    df = spark.createDataFrame([("x\n",), ("x",)], "s string")
    assert [r[0] for r in df.select(F.col("s").rlike(compile_regex("x$")[0])).collect()] == [False, True]
    one = spark.range(1)
    assert one.select(F.lit("a\u000bb").rlike(compile_regex(r"a\sb")[0])).first()[0] is False
    assert one.select(F.lit("   x　").alias("s")).select(trim_ws(F.col("s"))).first()[0] == "x"
    ints = spark.createDataFrame([("12",), ("+5",), (" 12",), ("1.0",), ("9223372036854775808",), ("",)], "s string")
    assert [r[0] for r in ints.select(to_int(F.col("s"))).collect()] == [12, 5, None, None, None, None]
