"""Output shaping queries over extracted pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import LINKS, absolute, decoded, query
from webtables.catalog.html import pages
from webtables.functions import select as S
from webtables.operators.html import extract_html
from webtables.operators.shape import first_or_empty, group_items, page_counts, shape
from webtables.plans.spec import Extract, Field
from webtables.functions.text import explode_rows
from webtables.sources.pages import encode_results

SPEC = Extract(
    scope=S.descendant("li"),
    fields={
        "label": Field(S.child("a")),
        "href": Field(S.child("a"), attr="href", resolve_url=True),
        "letters": Field(S.child("a"), regex="[a-z]", multiple=True),
        "none": Field(S.child("img"), attr="src"),
    },
    page={"title": Field(S.descendant("title")), "comma": Field(S.descendant("h1"), regex=r"[^,]+,", default="-")},
    meta={"lang": Field(S.descendant("html"), attr="lang"), "n_links": Field(S.descendant("footer"), regex="([0-9]+)")},
)
TEMPLATE = {"name": "{label}", "link": {"url": "{href}", "text": "{label} ({none})"}, "letters": "{letters}", "joined": "<{letters}>", "tags": ["x", "{label}"], "fixed": 7}
TITLE = decoded(decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)"))


def extracted(spark, sf):
    return extract_html(pages(spark, sf), SPEC, keep=["page_id"])


LETTERS = "array_to_string(regexp_extract_all(txt, '[a-z]'), ',')"


@query("format_record", f"WITH {LINKS} SELECT page_id, pos, txt AS name, {absolute('url', 'href')} AS url, txt || ' ()' AS text, {LETTERS} AS letters, '<' || {LETTERS} || '>' AS joined, 'x|' || txt AS tags, CAST(7 AS INTEGER) AS fixed FROM links")
def format_record(spark, sf):
    flat = explode_rows(shape(extracted(spark, sf), TEMPLATE), ["page_id"], "items")
    return flat.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "item.name", "item.link.url", "item.link.text",
        F.array_join("item.letters", ",").alias("letters"), "item.joined", F.array_join("item.tags", "|").alias("tags"), "item.fixed",
    )


@query("group_items", f"WITH {LINKS}, n AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id) SELECT page_id, 'T: ' || {TITLE} AS head, CAST(coalesce(n, 0) AS BIGINT) AS n_items FROM pages LEFT JOIN n USING (page_id)")
def group_items_(spark, sf):
    grouped = group_items(shape(extracted(spark, sf), {"n": "{label}"}), {"head": "T: {title}", "links": "{comma}"}, "links")
    return grouped.select("page_id", "data.head", F.size("data.links").cast("bigint").alias("n_items"))


@query("first_or_empty", f"WITH {LINKS} SELECT p.page_id, l.txt AS name FROM pages p LEFT JOIN links l ON l.page_id = p.page_id AND l.pos = 0")
def first_or_empty_(spark, sf):
    return shape(extracted(spark, sf), {"name": "{label}"}).select("page_id", first_or_empty(F.col("items"))["name"].alias("name"))


@query("page_counts", f"""WITH {LINKS}, n AS (SELECT page_id, count(*) AS n FROM links GROUP BY page_id), u AS (SELECT *, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages)
  SELECT page_id, CAST(coalesce(n, 0) AS BIGINT) AS count, CASE WHEN q LIKE '%page=%' THEN CAST(regexp_extract(q, 'page=([0-9]+)', 1) AS BIGINT) END AS page_num,
    CASE WHEN NOT q LIKE '%page=%' THEN q END AS page_raw, regexp_extract(html, '<html lang="([^"]*)"', 1) AS total FROM u LEFT JOIN n USING (page_id)""")
def page_counts_(spark, sf):
    src = pages(spark, sf).withColumn("q", F.regexp_extract("url", r"[?]([^#]*)", 1))
    ex = extract_html(src, SPEC, keep=["page_id", "q"])
    num = F.regexp_extract("q", "page=([0-9]+)", 1)
    out = page_counts(ex, F.when(num != "", F.concat(F.lit(" "), num)).otherwise(F.col("q")), F.col("meta.lang"))
    return out.select("page_id", "count", "page_num", "page_raw", "total")


@query("write_results", f"""WITH {LINKS}, d AS (SELECT page_id, string_agg('{{"w":' || to_json(txt) || ',"none":null}}', ',' ORDER BY pos) AS items FROM links GROUP BY page_id)
  SELECT page_id AS request_id, CASE WHEN page_id % 5 = 0 THEN '{{"ok":false,"site":"demo","task":"t","status":404,"error":{{"type":"http_error","reason":"status 404"}}}}'
    ELSE '{{"ok":true,"site":"demo","task":"t","url":' || to_json(url) || ',"status":200,"data":[' || coalesce(items, '') || ']}}' END AS value FROM pages LEFT JOIN d USING (page_id)""")
def write_results_(spark, sf):
    spec = Extract(scope=S.descendant("li"), fields={"label": Field(S.child("a")), "none": Field(S.child("img"), attr="src")})
    ex = shape(extract_html(pages(spark, sf), spec, keep=["page_id", "url"]), {"w": "{label}", "none": "{none}"})
    bad = F.col("page_id") % 5 == 0
    error = F.when(bad, F.struct(F.lit("http_error").alias("type"), F.lit("status 404").alias("reason"), F.lit(None).cast("array<string>").alias("matched")))
    res = ex.select(
        F.col("page_id").alias("request_id"), (~bad).alias("ok"), F.lit("demo").alias("site"), F.lit("t").alias("task"),
        F.when(~bad, F.col("url")).alias("url"), F.when(bad, 404).otherwise(200).alias("status"),
        F.when(~bad, F.col("items")).alias("data"), error.alias("error"),
    )
    return encode_results(res)
