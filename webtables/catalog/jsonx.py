"""JSON extraction queries over bodies derived from ``orders``; the SQL side never reads the JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import derive, query
from webtables.catalog.fixtures import JSON_ORDERS
from webtables.functions.text import explode_rows
from webtables.functions.variant import json_double, json_int, json_path, json_text, parse_json
from webtables.operators.html import explode_items
from webtables.operators.json import extract_json
from webtables.plans.spec import ALL, Extract, Field
from webtables.sources.pages import read_json_pages, spread_rows

J = f"j AS ({JSON_ORDERS}), g AS (SELECT * FROM j WHERE NOT (st = 'P' AND prio = '5-LOW'))"
# Hits of the search array: position 0 always, position 1 for open orders.
HITS = f"{J}, h AS (SELECT doc_id, 0 AS pos, ' ' || prio || ' ' AS title, doc_id AS pageid, CAST(ck AS VARCHAR) || '.5' AS w, st FROM g UNION ALL SELECT doc_id, 1, NULL, ck, CAST(ck AS VARCHAR), st FROM g WHERE st = 'O')"
TIME = "'+' || strftime(od, '%Y-%m-%d') || 'T00:00:00Z'"


def bodies(spark, sf):
    return spread_rows(derive(spark, sf, JSON_ORDERS), "doc_id").select("doc_id", "body")


def parsed(spark, sf):
    return bodies(spark, sf).select("doc_id", parse_json(F.col("body")).alias("v"))


def first(path):
    return json_text(F.get(json_path(F.col("v"), path), F.lit(0)))


@query("read_json_pages", f"WITH {J} SELECT doc_id, CASE WHEN st = 'P' AND prio = '5-LOW' THEN 'extract_error' END AS json_error FROM j")
def read_json(spark, sf):
    return read_json_pages(bodies(spark, sf)).select("doc_id", "json_error")


@query("json_path", f"WITH {J} SELECT j.doc_id, CAST(g.ck % 7 AS VARCHAR) AS total, CASE WHEN g.st = 'O' THEN CAST(g.ck AS VARCHAR) END AS second_id, CAST(NULL AS VARCHAR) AS wrong_kind, CAST(NULL AS VARCHAR) AS negative, CASE WHEN g.doc_id IS NOT NULL THEN 'P1' END AS p1 FROM j LEFT JOIN g USING (doc_id)")
def json_path_(spark, sf):
    return parsed(spark, sf).select(
        "doc_id",
        first(("query", "total")).alias("total"),
        first(("query", "search", 1, "pageid")).alias("second_id"),
        first(("query", 0)).alias("wrong_kind"),
        first(("query", "search", -1)).alias("negative"),
        first(("entities", "P1", "id")).alias("p1"),
    )


@query("json_wildcard", f"WITH {HITS}, a AS (SELECT doc_id, string_agg(CAST(pageid AS VARCHAR), ',' ORDER BY pos) AS ids FROM h GROUP BY doc_id) SELECT j.doc_id, coalesce(ids, '') AS ids, CASE WHEN ids IS NULL THEN '' ELSE 'P1,Q' || ck END AS entity_ids FROM j LEFT JOIN a USING (doc_id)")
def json_wildcard(spark, sf):
    def joined(path):
        return F.array_join(F.transform(json_path(F.col("v"), path), json_text), ",")

    # A body that is not JSON has no values.
    return parsed(spark, sf).select("doc_id", joined(("query", "search", ALL, "pageid")).alias("ids"), joined(("entities", ALL, "id")).alias("entity_ids"))


@query("json_scope", f"WITH {HITS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(pageid AS VARCHAR) AS pageid FROM h")
def json_scope(spark, sf):
    spec = Extract(type="json", scope=("query", "search", ALL), fields={"pageid": Field(path=("pageid",), type="string")})
    out = explode_items(extract_json(bodies(spark, sf), spec))
    return out.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "pageid")


@query("json_field", f"WITH {HITS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, title, coalesce(title, '?') AS dflt, CASE WHEN pos = 0 THEN st = 'F' END AS flag FROM h")
def json_field_(spark, sf):
    spec = Extract(
        type="json", scope=("query", "search", ALL),
        fields={"title": Field(path=("title",), type="string"), "dflt": Field(path=("title",), type="string", default="?"), "raw": Field(path=("title",))},
        page={"flag": Field(path=("flag",))},
    )
    out = extract_json(bodies(spark, sf), spec)
    flat = explode_rows(out, ["doc_id", "page"], "items")
    flag = F.try_variant_get("page.flag", "$", "boolean")
    return flat.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "item.title", "item.dflt", F.when(F.col("pos") == 0, flag).alias("flag"))


@query("json_clean", f"WITH {J} SELECT j.doc_id, g.prio AS title, CAST(regexp_extract(g.prio, '[0-9]+') AS BIGINT) AS rank, strftime(g.od, '%Y-%m-%d') AS day, CAST(NULL AS VARCHAR) AS nomatch FROM j LEFT JOIN g USING (doc_id)")
def json_clean(spark, sf):
    spec = Extract(type="json", page={
        "title": Field(path=("query", "search", 0, "title"), trim=True),
        "rank": Field(path=("query", "search", 0, "title"), regex=r"([0-9]+)-", type="int"),
        "day": Field(path=("entities", ALL, "time"), regex=r"^\+([0-9-]+)T", multiple=True),
        "nomatch": Field(path=("query", "search", 0, "title"), regex=r"zzz"),
    })
    out = extract_json(bodies(spark, sf), spec)
    return out.select("doc_id", "page.title", "page.rank", F.get("page.day", F.lit(0)).alias("day"), "page.nomatch")


@query("json_numbers", f"WITH {HITS} SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos = 1 THEN CAST(pageid AS BIGINT) END AS i, CASE WHEN pos = 0 THEN CAST(w AS DOUBLE) END AS d, w AS t FROM h")
def json_numbers(spark, sf):
    hits = parsed(spark, sf).select("doc_id", json_path(F.col("v"), ("query", "search", ALL, "w")).alias("ws"))
    flat = explode_rows(hits, ["doc_id"], "ws", "pos", "w")
    return flat.select("doc_id", F.col("pos").cast("bigint").alias("pos"), json_int(F.col("w")).alias("i"), json_double(F.col("w")).alias("d"), json_text(F.col("w")).alias("t"))


@query("json_layers", f"""WITH {J} SELECT j.doc_id, CASE WHEN g.doc_id IS NULL THEN 'invalid JSON' WHEN g.st = 'O' THEN 'field "title" is missing' END AS error, CASE WHEN g.st <> 'O' THEN CAST(g.ck % 7 AS BIGINT) END AS total,
  CASE WHEN g.st <> 'O' THEN 'Q' || g.ck END AS entity, CASE WHEN g.st <> 'O' THEN CAST(1 AS BIGINT) END AS n FROM j LEFT JOIN g USING (doc_id)""")
def json_layers(spark, sf):
    spec = Extract(
        type="json",
        scope=("query", "search", ALL),
        meta={"total": Field(path=("query", "total"), type="int", required=True)},
        page={"entity": Field(path=("entities", ALL, "id"), regex="^Q.*", multiple=True)},
        fields={"title": Field(path=("title",), trim=True, required=True)},
    )
    out = extract_json(bodies(spark, sf), spec)
    return out.select("doc_id", "error", "meta.total", F.get("page.entity", F.lit(0)).alias("entity"), F.size("items").cast("bigint").alias("n"))
