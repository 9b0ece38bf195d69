"""Lookup queries: an index derived from ``customer``, probes derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import derive, query
from webtables.catalog.fixtures import INDEX, PARAMS
from webtables.catalog.params import JOINED, KEYS, index
from webtables.operators import lookup as L

PROBES = f"SELECT request_id, name AS probe FROM ({PARAMS}) q"


def probes(spark, sf):
    return derive(spark, sf, f"SELECT request_id, name AS probe FROM ({PARAMS}) q")


@query("lookup_one", f"{JOINED} SELECT request_id, name AS probe, CASE status WHEN 'ok' THEN v END AS value, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, CAST(coalesce(nv, 0) AS BIGINT) AS n_values, status FROM j")
def lookup_one(spark, sf):
    return L.lookup_one(probes(spark, sf), index(spark, sf), "aliases", "id")


@query("lookup_find_all", f"WITH p AS ({PROBES}), ix AS ({INDEX}), k AS (SELECT pos, lower(trim(alias1)) AS key FROM ix UNION ALL SELECT pos, lower(trim(alias2)) FROM ix) SELECT request_id, pos FROM p JOIN k ON lower(trim(probe)) = key")
def lookup_find_all(spark, sf):
    return L.lookup_all(probes(spark, sf), index(spark, sf), "aliases").select("request_id", "pos")


@query("lookup_normalize", f"WITH p AS ({PROBES}) SELECT request_id, lower(trim(probe)) AS folded, trim(probe) AS exact FROM p")
def lookup_normalize(spark, sf):
    p = F.col("probe")
    return probes(spark, sf).select("request_id", L.normalize_key(p).alias("folded"), L.normalize_key(p, True).alias("exact"))


@query("lookup_multivalued", f"WITH ix AS ({INDEX}), {KEYS} SELECT key, CAST(count(*) AS BIGINT) AS n FROM k WHERE key <> '' GROUP BY key")
def lookup_multivalued(spark, sf):
    return L.index_keys(index(spark, sf), "aliases").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("lookup_report", f"""WITH p AS (SELECT DISTINCT probe FROM ({PROBES}) z), ix AS ({INDEX}), k AS (SELECT pos, lower(trim(alias1)) AS key FROM ix UNION ALL SELECT pos, lower(trim(alias2)) FROM ix)
  SELECT probe, count(pos) > 0 AS ok, CAST(count(pos) AS BIGINT) AS count, min(pos) AS first_pos, max(pos) AS last_pos FROM p LEFT JOIN k ON lower(trim(probe)) = key AND trim(probe) <> '' GROUP BY probe""")
def lookup_report(spark, sf):
    return L.lookup_report(probes(spark, sf), index(spark, sf), "aliases")[0]


@query("lookup_report_matches", f"""WITH p AS (SELECT DISTINCT probe FROM ({PROBES}) z), ix AS ({INDEX}), k AS (SELECT *, lower(trim(alias1)) AS key FROM ix UNION ALL SELECT *, lower(trim(alias2)) FROM ix)
  SELECT probe, pos, k.name, k.id, alias1 || '|' || alias2 AS aliases FROM p JOIN k ON lower(trim(probe)) = key AND trim(probe) <> ''""")
def lookup_report_matches(spark, sf):
    matches = L.lookup_report(probes(spark, sf), index(spark, sf), "aliases")[1]
    return matches.select("probe", "pos", "name", "id", F.array_join("aliases", "|").alias("aliases"))


@query("list_values", f"WITH ix AS ({INDEX}) SELECT pos, trim(id) AS value FROM ix WHERE trim(id) <> ''")
def list_values(spark, sf):
    return L.list_values(index(spark, sf), "id")


# One image per supplier name; some blank.
IMAGES = "SELECT s_name AS name, CASE WHEN s_acctbal < 1000 THEN '  ' ELSE concat('img/', CAST(s_suppkey AS STRING)) END AS url FROM supplier"
RECORDS = """SELECT l_orderkey * 10 + l_linenumber AS rec_id, l_orderkey, CASE WHEN l_returnflag = 'R' THEN ' Supplier#000000001 ' WHEN l_linestatus = 'F' THEN lower(s_name) WHEN l_returnflag = 'A' THEN ' ' ELSE s_name END AS name,
  concat('old/', CAST(l_linenumber AS STRING)) AS image FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
REC_KEY = "SELECT * FROM ({0}) r"


def images(spark, sf):
    return derive(spark, sf, IMAGES)


def records(spark, sf):
    return derive(spark, sf, RECORDS)


@query("lookup_left_replace", f"WITH r AS ({RECORDS}), i AS ({IMAGES}) SELECT rec_id, l_orderkey, r.name, CASE WHEN trim(i.url) <> '' THEN i.url ELSE image END AS image FROM r LEFT JOIN i ON trim(r.name) = i.name AND trim(r.name) <> ''")
def lookup_left_replace(spark, sf):
    return L.replace_if_found(records(spark, sf), images(spark, sf), "name", "image")


# Lists of records: three per order row, made in the row.
LIST_SQL = "SELECT o_orderkey AS rec_id, c_name AS a, concat('Supplier#', lpad(CAST(o_custkey % 50 AS STRING), 9, '0')) AS b FROM orders JOIN customer ON o_custkey = c_custkey"


@query("lookup_in_list", f"""WITH r AS ({LIST_SQL}), i AS (SELECT * FROM ({IMAGES}) z WHERE trim(url) <> ''),
  j AS (SELECT rec_id, coalesce(i1.url, 'o1') AS p0, coalesce(i2.url, 'o2') AS p1, coalesce(i2.url, 'o4') AS single FROM r LEFT JOIN i i1 ON i1.name = trim(a) LEFT JOIN i i2 ON i2.name = trim(b))
  SELECT rec_id, p0 || '|' || p1 || '|o3' AS images, single FROM j""")
def lookup_in_list(spark, sf):
    r = derive(spark, sf, LIST_SQL)

    def rec(name, image):
        return F.struct(name.alias("name"), F.lit(image).alias("image"))

    lists = r.select(
        "rec_id", F.array(rec(F.col("a"), "o1"), rec(F.concat(F.lit(" "), F.col("b")), "o2"), rec(F.lit(" "), "o3")).alias("people"),
        rec(F.col("b"), "o4").alias("one"),
    )
    out = L.replace_in_list(lists, images(spark, sf), "people")
    out = L.replace_in_list(out, images(spark, sf), "one")
    return out.select("rec_id", F.array_join(F.transform("people", lambda p: p["image"]), "|").alias("images"), F.col("one.image").alias("single"))


@query("lookup_or_not_found", f"""WITH r AS ({RECORDS}), i AS ({IMAGES}) SELECT rec_id, l_orderkey, CASE WHEN trim(i.url) <> '' THEN trim(r.name) END AS found_name, CASE WHEN trim(i.url) <> '' THEN i.url END AS image,
  CASE WHEN trim(r.name) = '' THEN 'param_error' WHEN i.url IS NULL OR trim(i.url) = '' THEN 'not_found' END AS type,
  CASE WHEN trim(r.name) = '' THEN 'name is required' WHEN i.url IS NULL OR trim(i.url) = '' THEN 'image not found for "' || trim(r.name) || '"' END AS reason
  FROM r LEFT JOIN i ON trim(r.name) = i.name""")
def lookup_or_not_found(spark, sf):
    r = records(spark, sf).drop("image")
    out = L.lookup_or_not_found(r, images(spark, sf), "name")
    return out.select("rec_id", "l_orderkey", "found_name", "image", "error.type", "error.reason")
