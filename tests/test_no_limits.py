"""Inputs past what used to be limits, and pages that must not end a job."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tests.test_tables import listing
from webtables.functions.dom import parse_dom
from webtables.functions import select as S
from webtables.functions.entities import unescape
from webtables.functions.wikitext import fallback_links
from webtables.operators import listing as L
from webtables.sources.pages import decode_bodies, encode_results


def test_all_fallback_links(spark):
    urls = spark.createDataFrame([([f"https://h.example/{i}" for i in range(25)],)], "u array<string>")
    assert len(urls.select(fallback_links(F.col("u"))).first()[0]) == 25


def test_long_listing(spark):
    pages = spark.range(1, 3001).select(F.col("id").alias("page"), F.lit(1).alias("n_items"))
    last = L.last_page(pages)
    assert last.first().last_page == 3000
    assert [r.page for r in L.check_complete(pages.where("page NOT IN (7, 2500)"), last).orderBy("page").collect()] == [7, 2500]
    assert L.last_page(pages, max_pages=2000).first().last_page == 2000
    assert L.all_pages(last, []).count() == 3000


def test_late_attempts_count(spark):
    rows = listing(spark, [(1, 9, True, [("1", None, "a")]), (1, 12, True, [("1", None, "b")])])
    assert [r.attempt for r in L.pick_attempt(rows).collect()] == [9]
    assert L.pick_attempt(rows, retries=8).collect() == []
    out, header, missing = L.build_index(rows)
    L.require_complete(header, missing)
    assert [r.name for r in out.collect()] == ["a"]


def test_long_hex_reference(spark):
    df = spark.createDataFrame([("&#x00000000000000041;&#x41;&#0000000000000000066;&#xFFFFFFFFFFFFFFFF;&#x0;",)], "s string")
    assert df.select(unescape(F.col("s"))).first()[0] == "AAB��"


def test_late_meta_charset(spark):
    body = b"<html><head>" + b"<!-- x -->" * 300 + b'<meta charset="koi8-r"></head>\xf0\xd2</html>'
    df = spark.createDataFrame([(bytearray(body), "text/html"), (bytearray(b"ok \xff end"), "text/html; charset=utf-8")], "body binary, content_type string")
    out = [r.body for r in decode_bodies(df).collect()]
    assert out[0].endswith("Пр</html>") and out[1] == "ok � end"


def _text(spark, body):
    row = spark.createDataFrame([(body,)], "body string").select(parse_dom(F.col("body")).alias("d")).first().d
    return {n.tag: bytes(row.text)[n.t0 : n.t1].decode() for n in row.nodes}, bytes(row.html).decode()


def test_raw_text_elements(spark):
    tags, html = _text(spark, "<title><b>x</b> &amp; y</title><iframe><a href=1>q</a></iframe><textarea><i>t</i> &lt;</textarea><xmp><p>&amp;</xmp><p>end")
    assert tags["title"] == "<b>x</b> & y" and tags["iframe"] == "<a href=1>q</a>" and tags["textarea"] == "<i>t</i> <" and tags["xmp"] == "<p>&amp;"
    assert not {"a", "b", "i"} & set(tags) and tags["p"] == "end"
    assert "<title>&lt;b&gt;x&lt;/b&gt; &amp; y</title>" in html and "<iframe><a href=1>q</a></iframe>" in html
    assert _text(spark, "<title>open &amp; on<p>x")[0]["title"] == "open & on<p>x"


def test_invalid_bytes_do_not_end_a_job(spark):
    rnd = random.Random(1)
    bodies = [bytearray(rnd.randbytes(rnd.randint(0, 300)) + b"<p>x</p>" + rnd.randbytes(5)) for _ in range(200)] + [bytearray(b"<p>a\xffb</p>")]
    df = spark.createDataFrame([(b,) for b in bodies], "b binary").select(F.col("b").cast("string").alias("body"))
    out = df.select(parse_dom(F.col("body")).alias("d")).collect()
    assert len(out) == 201 and all(r.d.nodes for r in out) and bytes(out[-1].d.text).decode() == "a�b"


def test_nth_on_a_large_page(spark):
    from time import time

    body = "<ul>" + "".join(f"<li><b>{i}</b><b>x</b></li>" for i in range(10_000)) + "</ul>"
    df = spark.createDataFrame([(body,)], "body string").select(parse_dom(F.col("body"), with_html=False).alias("d")).cache()
    df.count()
    node = F.get("d.nodes", F.lit(0))
    start = time()
    got = df.select(*[F.size(s.apply(F.col("d"), node)) for s in (S.descendant("b").nth(2), S.descendant("b").nth(-1), S.descendant("b").nth(3), S.descendant("li").nth(7))]).first()
    assert tuple(got) == (10_000, 10_000, 0, 1) and time() - start < 20


def test_empty_object_is_written(spark):
    rows = spark.createDataFrame([(1, True, "s", "t", None), (2, False, "s", "t", None), (3, True, "s", "t", ("x",))], "request_id int, ok boolean, site string, task string, data struct<name:string>")
    got = {r.request_id: r.value for r in encode_results(rows).collect()}
    assert got[1].endswith('"data":{}}') and '"data"' not in got[2] and got[3].endswith('"data":{"name":"x"}}')
