"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import derive, query, table
from webtables.catalog.fixtures import ASSETS, INDEX, SNAPSHOTS
from webtables.catalog.html import pages
from webtables.operators.lookup import lookup_one
from webtables.plans.scratch import scratch_path
from webtables.sources import assets as A
from webtables.sources import index as I
from webtables.sources import pages as P
from webtables.sources.json_split import read_index_split as read_split


@query("read_pages", "SELECT page_id AS request_id, 'demo' AS site, 'list' AS task, CAST(200 AS INTEGER) AS status, url AS final_url, html AS body, 'http' AS channel, CAST(NULL AS VARCHAR) AS fetch_error FROM pages")
def read_pages(spark, sf):
    return P.read_pages(spark, f"{sf}/pages.parquet", site="demo", task="list").drop("headers")


@query("decode_bodies", """SELECT page_id, html AS body FROM pages""")
def decode_bodies(spark, sf):
    p = pages(spark, sf).select("page_id", "html")
    k = F.col("page_id") % 4
    latin_ok = F.col("html").rlike(r"^[\x00-\x7f\xa0-\xff]*$")
    raw = (
        F.when(k == 0, F.encode("html", "UTF-16LE"))
        .when((k == 1) & latin_ok, F.encode("html", "ISO-8859-1"))
        .otherwise(F.encode("html", "UTF-8"))
    )
    ctype = (
        F.when(k == 0, "text/html; charset=UTF-16LE")
        .when((k == 1) & latin_ok, 'text/html; charset="windows-1252"')
        .when(k == 2, "text/html")
        .otherwise("text/html; Charset=utf8")
    )
    return P.decode_bodies(p.select("page_id", raw.alias("body"), ctype.alias("content_type"))).select("page_id", "body")


@query("decode_bodies_rare", """SELECT page_id, html AS body FROM pages""")
def decode_bodies_rare(spark, sf):
    # Charsets outside the JVM set: UTF-32 and a Latin superset, through the Arrow step.
    p = pages(spark, sf).select("page_id", "html")
    raw = F.encode("html", "UTF-32")
    out = P.decode_bodies(p.select("page_id", raw.alias("body"), F.lit("text/html; charset=utf-32be").alias("content_type")))
    return out.select("page_id", "body")


@query("read_index_document", f"WITH ix AS ({INDEX}) SELECT name, id, alias1, alias2 FROM ix")
def read_index_document(spark, sf):
    """Write the index as one JSON document in text parts, then read its items back in parallel."""
    path = scratch_path(spark, "index-document")
    rows = derive(spark, sf, INDEX).withColumn("page", F.lit(1)).drop("grp")
    header = rows.agg(F.count(F.lit(1)).alias("count")).withColumn("total_pages", F.lit(1))
    I.write_index_document(rows, header, path)
    return I.read_index_lines(spark, path, "name string, id string, alias1 string, alias2 string")


def index_document(spark, sf, name, **more):
    """The index as one JSON document in text parts; its path."""
    path = scratch_path(spark, name)
    rows = derive(spark, sf, INDEX).withColumn("page", F.lit(1)).drop("grp")
    header = rows.agg(F.count(F.lit(1)).alias("count")).withColumn("total_pages", F.lit(1))
    I.write_index_document(rows, header, path, **more)
    return path


@query("read_index_split", f"WITH ix AS ({INDEX}) SELECT name, id, alias1, alias2, row_number() OVER (ORDER BY pos) - 1 AS pos FROM ix")
def read_index_split(spark, sf):
    """The parts read by splits as one JSON object, under a key that also occurs in a text."""
    path = index_document(spark, sf, "index-split", items_name="people", meta={"note": 'a "people": [ in a text }'})
    return read_split(spark, path, "people", "name string, id string, alias1 string, alias2 string")


@query("read_index_keys", f"WITH ix AS ({INDEX}) SELECT name, id, row_number() OVER (ORDER BY pos) - 1 AS pos, 'index does not contain items key \"people\"' AS missing FROM ix")
def read_index_keys(spark, sf):
    """The default key, and the message for a key that the document does not have."""
    path = index_document(spark, sf, "index-keys")
    try:
        missing = str(read_split(spark, path, "people"))
    except ValueError as e:
        missing = str(e)
    rows = read_split(spark, path, " ")
    field = F.variant_get("item", "$.name", "string"), F.variant_get("item", "$.id", "string")
    return rows.select(field[0].alias("name"), field[1].alias("id"), "pos", F.lit(missing.replace("'", '"')).alias("missing"))


LEVELS = [
    {"label": "1-URGENT", "code": "u"}, {"label": "2-HIGH", "code": "h"}, {"label": "3-MEDIUM", "code": ""},
    {"label": "5-LOW", "code": "l"}, {"label": "5-low", "code": "x"},
]


@query("index_from_items", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'u' WHEN '2-HIGH' THEN 'h' END AS value,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ok' WHEN '2-HIGH' THEN 'ok' WHEN '3-MEDIUM' THEN 'no_value' WHEN '5-LOW' THEN 'ambiguous' ELSE 'no_match' END AS status FROM orders""")
def index_from_items(spark, sf):
    ix = I.index_from_items(spark, LEVELS, "label string, code string")
    probes = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("probe"))
    return lookup_one(probes, ix, "label", "code").select("o_orderkey", "value", "status")


def trees(spark, sf):
    """One JSON tree per part; document order across trees is the part key."""
    leaf = derive(spark, sf, ASSETS)
    inner = F.map_from_entries(F.array(F.struct(F.lit("blank.png").alias("k"), F.lit(" ").alias("v")), F.struct(F.col("entry").alias("k"), F.col("file").alias("v"))))
    body = F.to_json(F.struct(F.map_from_entries(F.array(F.struct(F.col("grp"), inner))).alias("Content")))
    return leaf.select("tree", body.alias("body"))


SEG = "replace(replace(replace(replace(url_encode({0}), '%2B', '+'), '%26', '&'), '%3D', '='), '%24', '$')"
URL_SQL = f"'https://cdn.example/x/Content/' || {SEG.format('grp')} || '/' || {SEG.format(chr(39).join(['split_part(file, ', '?', ', 1)']))} || CASE WHEN contains(file, '?') THEN '?' || split_part(file, '?', 2) ELSE '' END"


@query("flatten_image_tree", f"WITH a AS ({ASSETS}), w AS (SELECT regexp_replace(entry, '[.]jpg$', '') AS name, arg_max(struct_pack(grp := grp, file := file), tree) AS w FROM a GROUP BY 1), u AS (SELECT name, w.grp AS grp, w.file AS file FROM w) SELECT name, {URL_SQL} AS url FROM u")
def flatten_image_tree(spark, sf):
    return A.flatten_image_tree(trees(spark, sf), "https://cdn.example/x/", order=["tree", "i", "j"])


@query("build_asset_url", f"WITH a AS ({ASSETS}) SELECT tree, {URL_SQL} AS url FROM a")
def build_asset_url(spark, sf):
    return derive(spark, sf, ASSETS).select("tree", A.build_asset_url("https://cdn.example/x", F.col("grp"), F.col("file")).alias("url"))


def snapshot_sql(ttl_us):
    fresh = f"kind = 'cache' AND epoch_us(TIMESTAMP '2024-01-16 00:00:00') - epoch_us(captured_at) <= {ttl_us}" if ttl_us is not None else "false"
    return f"""WITH s AS ({SNAPSHOTS}), r AS (SELECT *, CASE WHEN {fresh} THEN 0 WHEN kind = 'download' AND ok THEN 1 WHEN kind = 'cache' THEN 2 END AS freshness FROM s)
    SELECT source, snapshot_id, body, freshness FROM r WHERE freshness IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY freshness, captured_at DESC, snapshot_id) = 1"""


@query("snapshot_with_ttl", snapshot_sql(24 * 3600 * 1_000_000))
def snapshot_with_ttl(spark, sf):
    out = A.snapshot_with_ttl(derive(spark, sf, SNAPSHOTS), F.lit("2024-01-16 00:00:00").cast("timestamp"))
    return out.select("source", "snapshot_id", "body", "freshness")


@query("snapshot_never_fresh", snapshot_sql(None))
def snapshot_never_fresh(spark, sf):
    out = A.snapshot_with_ttl(derive(spark, sf, SNAPSHOTS), F.lit("2024-01-16 00:00:00").cast("timestamp"), ttl_seconds=-1)
    return out.select("source", "snapshot_id", "body", "freshness")


@query("write_page_dump", "SELECT page_id AS request_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS site, 'list' AS task, html AS body FROM pages")
def write_page_dump(spark, sf):
    path = scratch_path(spark, "dump")
    r = P.read_pages(spark, f"{sf}/pages.parquet", task="list").withColumn("site", F.regexp_extract("final_url", "^https?://([^/?#]+)", 1))
    P.write_page_dump(r, path)
    return spark.read.parquet(path).select("request_id", "site", "task", "body")
