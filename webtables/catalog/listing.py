"""Index build queries: every captured page is a listing page, its navigation links are the items."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import LINKS, derive, query, table
from webtables.catalog.fixtures import LISTING_LINK_ID, LISTING_LINK_URL
from webtables.catalog.html import pages
from webtables.functions import select as S
from webtables.operators import listing as L
from webtables.operators.html import extract_html
from webtables.plans.scratch import scratch_path, write_then_read
from webtables.plans.spec import Extract, Field
from webtables.sources.index import document_lines
from webtables.streaming.extract import table_files
from webtables.streaming.index import IndexStream

LAST = "(SELECT coalesce(min(p) - 1, (SELECT max(page) FROM w)) FROM range(1, (SELECT max(page) + 2 FROM w)) t(p) WHERE p NOT IN (SELECT page FROM w WHERE n > 0))"
ITEMS = f"""{LINKS}, i AS (SELECT page_id + 1 AS page, pos, {LISTING_LINK_ID} AS id, {LISTING_LINK_URL} AS url, txt AS name FROM links),
  w AS (SELECT p.page_id + 1 AS page, count(l.pos) AS n FROM pages p LEFT JOIN links l USING (page_id) GROUP BY p.page_id)"""
MERGE = """k AS (SELECT *, coalesce(nullif(trim(id), ''), nullif(trim(url), '')) AS key FROM {src}),
  m AS (SELECT page, pos, id, url, name FROM k WHERE key IS NULL UNION ALL
        SELECT page, pos, id, url, name FROM k WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY page, pos) = 1)"""


def record_list(df):
    """page, data: one record list per page, in the shape a listing task returns."""
    spec = Extract(scope=S.descendant("li"), fields={"txt": Field(S.child("a")), "href": Field(S.child("a"), attr="href")})
    ex = extract_html(df, spec, keep=["page_id"])

    def item(i):
        n = F.length(i["txt"])
        return F.struct(
            F.when((n % 4 == 1) | (n % 7 == 3), "  ").otherwise(F.lower(i["txt"])).alias("id"),
            F.when(n % 7 != 3, i["href"]).alias("url"),
            i["txt"].alias("name"),
        )

    return ex.select((F.col("page_id") + 1).alias("page"), F.struct(F.lit("x").alias("head"), F.transform("items", item).alias("links")).alias("data"))


def link_items(spark, sf):
    return record_list(pages(spark, sf)).select("page", F.col("data.links").alias("items"))


def listing(spark, sf):
    """Attempts: every fifth page fails first; every eleventh fails within the first-pass budget twice."""
    base = link_items(spark, sf)
    plan = F.when(F.col("page") % 5 == 0, F.array(F.struct(F.lit(0).alias("attempt"), F.lit(False).alias("ok")), F.struct(F.lit(1).alias("attempt"), F.lit(True).alias("ok")), F.struct(F.lit(2).alias("attempt"), F.lit(True).alias("ok")))).otherwise(
        F.array(F.struct(F.lit(0).alias("attempt"), F.lit(True).alias("ok")))
    )
    tried = base.select("page", "items", F.explode(plan).alias("t"))
    return tried.select("page", "t.attempt", "t.ok", F.when(F.col("t.ok"), F.col("items")).alias("items"))


@query("pick_attempt", f"WITH {ITEMS} SELECT page, CAST(CASE WHEN page % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempt, CAST(n AS BIGINT) AS n FROM w")
def pick_attempt(spark, sf):
    return L.pick_attempt(listing(spark, sf)).select("page", "attempt", F.size("items").cast("bigint").alias("n"))


@query("items_under_key", f"WITH {ITEMS} SELECT page, pos, id, url, name FROM i")
def items_under_key(spark, sf):
    return L.items_under_key(record_list(pages(spark, sf)), task_key="links").withColumn("pos", F.col("pos").cast("bigint"))


@query("last_page", f"WITH {ITEMS} SELECT CAST({LAST} AS BIGINT) AS last_page")
def last_page(spark, sf):
    return L.last_page(link_items(spark, sf).select("page", F.size("items").alias("n_items")))


SITES = """SELECT concat('site', CAST(page_id % 7 AS STRING)) AS site, CAST(floor(page_id / 7) AS BIGINT) + 1 AS page, length(url) % 29 AS n_items FROM pages"""


@query("last_page_by_site", f"""WITH s AS ({SITES}), x AS (SELECT site, min(page) FILTER (n_items = 0) AS gap, max(page) AS top FROM s GROUP BY site)
  SELECT site, coalesce(gap - 1, top) AS last_page FROM x WHERE coalesce(gap, 2) > 1""")
def last_page_by_site(spark, sf):
    return L.last_page(derive(spark, sf, SITES), by=["site"])


@query("check_complete", f"WITH {ITEMS} SELECT p AS page FROM range(1, (SELECT max(page) + 1 FROM w)) t(p) WHERE p NOT IN (SELECT page_id + 1 FROM pages WHERE contains(html, '</body>'))")
def check_complete(spark, sf):
    """Truncated captures count as failed."""
    p = table(spark, sf, "pages").select((F.col("page_id") + 1).alias("page"), F.contains("html", F.lit("</body>")).alias("ok"))
    last = p.agg(F.max("page").alias("last_page"))
    return L.check_complete(p.where("ok"), last)


@query("merge_dedupe", f"WITH {ITEMS}, {MERGE.format(src='i')} SELECT * FROM m")
def merge_dedupe(spark, sf):
    flat = write_then_read(L.items_under_key(record_list(pages(spark, sf)), "links"), "items")
    return L.merge_dedupe(flat).withColumn("pos", F.col("pos").cast("bigint"))


BUILT = f"{ITEMS}, z AS (SELECT * FROM i WHERE page <= {LAST}), {MERGE.format(src='z')}"


@query("build_index", f"WITH {BUILT} SELECT * FROM m")
def build_index(spark, sf):
    rows, header, missing = L.build_index(write_then_read(listing(spark, sf), "listing"))
    L.require_complete(header, missing)
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("write_index_document", f"""WITH {BUILT}, f AS (SELECT min(page * 100000 + pos) AS k FROM m)
  SELECT 1 AS part, page, pos, CASE WHEN page * 100000 + pos = f.k THEN '' ELSE ',' END || '{{"id":' || to_json(id) || ',"url":' || coalesce(to_json(url), 'null') || ',"name":' || to_json(name) || '}}' AS line FROM m, f
  UNION ALL SELECT 0, 0, 0, '{{"site":"demo","kind":"links","total_pages":' || CAST({LAST} AS VARCHAR) || ',"count":' || (SELECT count(*) FROM m) || ',"items":['
  UNION ALL SELECT 2, 0, 0, ']}}'""")
def write_index_document(spark, sf):
    rows, header, _ = L.build_index(write_then_read(listing(spark, sf), "listing"))
    return document_lines(rows, header, meta={"site": "demo", "kind": "links"})


@query("stream_index", f"WITH {ITEMS}, {MERGE.format(src='i')} SELECT * FROM m")
def stream_index(spark, sf):
    """The listing arrives as a stream of pages; the merged table equals the batch result."""
    out = scratch_path(spark, "stream-index")
    flow = IndexStream.over_pages(spark, table_files(sf, "pages.parquet"), "*", lambda df: L.items_under_key(record_list(df), "links"), f"{out}/index", f"{out}/checkpoint")
    return flow.run().withColumn("pos", F.col("pos").cast("bigint"))

