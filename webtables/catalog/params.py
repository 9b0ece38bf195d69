"""Request planning queries over parameter rows derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import derive, query
from webtables.catalog.fixtures import INDEX, PARAMS
from webtables.functions import templates as P
from webtables.functions import text as X
from webtables.functions import urls as U
from webtables.operators import params as R
from webtables.sources.pages import spread_rows

Q = f"q AS ({PARAMS})"
IX = f"ix AS ({INDEX})"


def raw(spark, sf):
    return spread_rows(derive(spark, sf, PARAMS), "request_id")


def rows(spark, sf):
    """request_id, params map (absent keys left out), cookie."""
    r = raw(spark, sf)
    entries = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("code", "page", "keyword", "name")]),
        lambda e: e["v"].isNotNull(),
    )
    return r.select("request_id", F.map_from_entries(entries).alias("params"), "cookie")


def index(spark, sf):
    ix = derive(spark, sf, INDEX)
    return ix.select("pos", "name", "id", F.array("alias1", "alias2").alias("aliases"), "grp")


def val(name):
    return F.try_element_at(F.col("params"), F.lit(name)).alias(name)


SPEC = {
    "code": {"required": True, "regex": r"(?i)^ord-([0-9]+)$"},
    "page": {},
    "keyword": {"default": "none"},
    "lang": {"default": "en"},
}


@query("param_defaults", f"WITH {Q} SELECT request_id, coalesce(page, '7') AS page, coalesce(code, 'x') AS code, 'en' AS lang FROM q")
def param_defaults(spark, sf):
    p = R.param_defaults(F.col("params"), {"page": {"default": "7"}, "code": {"default": "x"}, "lang": {"default": "en"}})
    return rows(spark, sf).select("request_id", p.alias("params")).select("request_id", val("page"), val("code"), val("lang"))


KEYS = "k AS (SELECT lower(trim(alias1)) AS key, nullif(trim(id), '') AS v FROM ix UNION ALL SELECT lower(trim(alias2)), nullif(trim(id), '') FROM ix)"
ONE = "t AS (SELECT key, count(*) AS n, count(DISTINCT v) AS nv, min(v) AS v FROM k WHERE key <> '' GROUP BY key)"
STATUS = "CASE WHEN trim(q.name) = '' THEN 'blank' WHEN t.n IS NULL THEN 'no_match' WHEN nv = 0 THEN 'no_value' WHEN nv > 1 THEN 'ambiguous' ELSE 'ok' END"
JOINED = f"WITH {Q}, {IX}, {KEYS}, {ONE}, j AS (SELECT q.*, t.v, t.n, t.nv, {STATUS} AS status FROM q LEFT JOIN t ON lower(trim(q.name)) = t.key)"

RESOLVE = {"cust": {"index": "people", "from": "name", "match_field": "aliases", "value_field": "id"}}


def resolved(spark, sf, optional):
    task = {"resolve_params": {"cust": {**RESOLVE["cust"], "optional": optional}}}
    df = rows(spark, sf).withColumn("error", F.lit(None).cast("string"))
    out = R.resolve_params(df, task, {"people": {}}, {"people": index(spark, sf)})
    return out.select("request_id", val("cust"), "error")


ERR = "'resolve param \"cust\" from \"name\"=\"' || trim(name) || '\": ' || status"


@query("param_resolve", f"{JOINED} SELECT request_id, CASE status WHEN 'ok' THEN v END AS cust, CASE WHEN status IN ('no_match', 'no_value', 'ambiguous') THEN {ERR} END AS error FROM j")
def param_resolve(spark, sf):
    return resolved(spark, sf, False)


@query("param_resolve_optional", f"{JOINED} SELECT request_id, CASE status WHEN 'ok' THEN v END AS cust, CASE WHEN status = 'ambiguous' THEN {ERR} END AS error FROM j")
def param_resolve_optional(spark, sf):
    return resolved(spark, sf, True)


@query("param_field_fallback", f"WITH {Q}, {IX}, t AS (SELECT lower(name) AS key, trim(id) AS v FROM ix WHERE trim(id) <> '') SELECT request_id, t.v AS id, coalesce(nullif(trim(code), ''), nullif(trim(page), ''), keyword) AS first_set FROM q LEFT JOIN t ON lower(trim(q.name)) = t.key")
def param_field_fallback(spark, sf):
    # No field names given: match on the source parameter's name, return the target parameter's.
    task = {"resolve_params": {"id": {"index": "people", "from": "name", "optional": True}}}
    df = rows(spark, sf).withColumn("error", F.lit(None).cast("string"))
    out = R.resolve_params(df, task, {"people": {}}, {"people": index(spark, sf)})
    first = X.first_non_blank(F.trim(val("code")), F.trim(val("page")), F.try_element_at("params", F.lit("keyword")))
    return out.select("request_id", val("id"), first.alias("first_set"))


#: The level of a keyword: quoted text, a class by name, and letters whose case folds beyond ASCII.
LEVEL = r"(?i)^[[:digit:]]-(\pL[\pL\s]*?)\s+\Q~*&\EÜ$"


@query("param_normalize_regex", f"""WITH {Q} SELECT request_id, CASE WHEN trim(code) <> '' AND regexp_matches(trim(code), '(?i)^ord-[0-9]*[02468]$') THEN regexp_extract(trim(code), '[0-9]+') ELSE code END AS code,
  CASE WHEN trim(keyword) <> '' THEN regexp_extract(trim(keyword), '{LEVEL}', 1) ELSE keyword END AS keyword,
  CASE WHEN trim(coalesce(code, '')) <> '' AND NOT regexp_matches(trim(code), '(?i)^ord-[0-9]*[02468]$') THEN 'param "code" value "' || trim(code) || '" does not match' END AS error FROM q""")
def param_normalize_regex(spark, sf):
    df = rows(spark, sf).withColumn("error", F.lit(None).cast("string"))
    out = R.normalize_params(df, {"code": {"regex": r"(?i)^ord-([0-9]*[02468])$"}, "keyword": {"regex": LEVEL}})
    return out.select("request_id", val("code"), val("keyword"), "error")


@query("param_required", f"WITH {Q} SELECT request_id, CASE WHEN trim(coalesce(code, '')) = '' THEN 'required param \"code\" is missing' WHEN trim(coalesce(page, '')) = '' THEN 'required param \"page\" is missing' END AS error FROM q")
def param_required(spark, sf):
    df = rows(spark, sf).withColumn("error", F.lit(None).cast("string"))
    return R.normalize_params(df, {"code": {"required": True}, "page": {"required": True}}).select("request_id", "error")


@query("pagination_default", f"WITH {Q} SELECT request_id, coalesce(nullif(trim(page), ''), '1') AS page FROM q")
def pagination_default(spark, sf):
    p = R.pagination_default(F.col("params"), {"param": "page", "default": "1"})
    return rows(spark, sf).select("request_id", p.alias("params")).select("request_id", val("page"))


@query("render_template", f"""WITH {Q} SELECT request_id, 'k=' || keyword || '/' || CAST(request_id AS VARCHAR) || '/a,b' || coalesce(page, '') AS typed,
  CASE WHEN code IS NOT NULL AND page IS NOT NULL THEN code || '-' || page END AS text, concat_ws(', ', CASE WHEN code IS NULL THEN 'code' END, CASE WHEN page IS NULL THEN 'page' END) AS missing FROM q""")
def render_template(spark, sf):
    df = rows(spark, sf)
    typed = P.render(
        "k={keyword}/{id}/{tags}{page}",
        {"keyword": val("keyword"), "id": F.col("request_id"), "tags": F.array(F.lit("a"), F.lit("b")), "page": val("page")},
        {"tags": "array<string>"},
    )
    t = "{code}-{page}"
    return df.select("request_id", typed.alias("typed"), P.render_map(t, F.col("params")).alias("text"), P.missing_keys(t, F.col("params")).alias("missing"))


TEMPLATE_SQL = "'/' || lower(o_orderstatus) || '/{code}/{' || replace(lower(o_orderpriority), ' ', '_') || '}?p={page}&c={code}&' || '{x' || CAST(o_custkey % 5 AS VARCHAR) || '}{}'"


@query("template_placeholders", f"WITH t AS (SELECT o_orderkey AS request_id, {TEMPLATE_SQL} AS t FROM orders), n AS (SELECT request_id, 'code' AS a, regexp_extract(t, '/code', 0) AS z, regexp_extract(t, '[{{]([0-9][^{{}}]*)[}}]', 1) AS b, regexp_extract(t, 'x[0-9]') AS c FROM t) SELECT request_id, 'code,' || b || ',page,' || c AS names FROM n")
def template_placeholders(spark, sf):
    t = derive(spark, sf, f"SELECT o_orderkey AS request_id, {TEMPLATE_SQL.replace('VARCHAR', 'STRING')} AS t FROM orders")
    return t.select("request_id", F.array_join(P.placeholders_of(F.col("t")), ",").alias("names"))


ENC = "replace(replace(replace(url_encode({0}), '%20', '+'), '%2A', '%2A'), '%7E', '~')"


@query("build_url", f"""WITH {Q} SELECT request_id, 'https://a.example/x/' || CAST(request_id % 100 AS VARCHAR) || '/list?keep=1&q=' || {ENC.format('keyword')} AS path_url,
  'http://b.example/s/' || CAST(request_id % 100 AS VARCHAR) || '?q=' || {ENC.format('keyword')} AS full_url FROM q""")
def build_url(spark, sf):
    df = rows(spark, sf).withColumn("params", R.put(F.col("params"), "n", (F.col("request_id") % 100).cast("string")))
    p = F.col("params")
    path = R.build_url("https://a.example/base/index", {"path": "/x/{n}/./y/../list?keep=1&q=old", "query": {"q": "{keyword}"}}, p)
    full = R.build_url("", {"url": "http://b.example/s/{n}", "query": {"q": "{keyword}"}}, p)
    return df.select("request_id", path.alias("path_url"), full.alias("full_url"))


@query("encode_query", f"WITH {Q} SELECT request_id, 'a=' || {ENC.format('coalesce(keyword, chr(32))')} || '&b=' || {ENC.format('coalesce(cookie, chr(32))')} || '&z=1+2' AS query FROM q")
def encode_query(spark, sf):
    e = F.array(
        F.struct(F.lit("z").alias("k"), F.lit("1 2").alias("v")),
        F.struct(F.lit("b").alias("k"), F.coalesce("cookie", F.lit(" ")).alias("v")),
        F.struct(F.lit("a").alias("k"), F.coalesce(F.try_element_at("params", F.lit("keyword")), F.lit(" ")).alias("v")),
    )
    return rows(spark, sf).select("request_id", U.encode_query(e).alias("query"))


@query("omit_empty_query", f"""WITH {Q} SELECT request_id, 'https://a.example/s' || CASE WHEN trim(coalesce(page, '')) = '' AND trim(keyword) = '' THEN '' ELSE '?' || concat_ws('&',
  CASE WHEN trim(keyword) <> '' THEN 'k=' || {ENC.format('keyword')} END, CASE WHEN trim(coalesce(page, '')) <> '' THEN 'page=' || {ENC.format('page')} END) END AS url FROM q""")
def omit_empty_query(spark, sf):
    request = {"path": "/s", "query": {"page": "{page}", "k": "{keyword}", "none": "{nothing}"}, "omit_empty_query": True}
    return rows(spark, sf).select("request_id", R.build_url("https://a.example", request, F.col("params")).alias("url"))


@query("merge_headers", f"WITH {Q} SELECT request_id, 'site' AS accept, 'task ' || keyword AS referer, 'ü' AS x, CASE WHEN page IS NULL THEN 'default' ELSE page END AS over FROM q")
def merge_headers(spark, sf):
    df = rows(spark, sf)
    h = R.merge_headers({"Accept": "site", "Referer": "site {keyword}"}, {"Referer": "task {keyword}", "X": "ü"}, F.col("params"))
    over = R.merge_header_maps(F.create_map(F.lit("page"), F.lit("default")), F.col("params"))
    return df.select("request_id", h["Accept"].alias("accept"), h["Referer"].alias("referer"), h["X"].alias("x"), over["page"].alias("over"))


@query("choose_cookie", f"WITH {Q} SELECT request_id, CASE WHEN trim(coalesce(cookie, '')) <> '' THEN cookie ELSE 'k=' || keyword END AS cookie FROM q")
def choose_cookie(spark, sf):
    return rows(spark, sf).select("request_id", R.choose_cookie(F.col("cookie"), P.render_map("k={keyword}", F.col("params"))).alias("cookie"))


@query("parse_cookies", f"""WITH {Q}, s AS (SELECT request_id, unnest(string_split(cookie, ';')) AS part FROM q WHERE cookie IS NOT NULL)
  SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY CASE trim(split_part(part, '=', 1)) WHEN 'a' THEN 0 WHEN 'b' THEN 1 ELSE 2 END) - 1 AS pos,
    trim(split_part(part, '=', 1)) AS name, trim(substr(part, instr(part, '=') + 1)) AS value FROM s WHERE contains(part, '=')""")
def parse_cookies(spark, sf):
    df = rows(spark, sf)
    out = X.explode_rows(df, ["request_id"], R.parse_cookies(F.col("cookie")), "pos", "c")
    return out.select("request_id", F.col("pos").cast("bigint").alias("pos"), "c.name", "c.value")


SITE = {"base_url": "https://a.example/", "indexes": {"people": {"match_field": "aliases", "value_field": "id"}}, "defaults": {"headers": {"Accept": "x"}, "cookie": "p={page}"}}
TASK = {
    "params": {"code": {"required": True, "regex": r"(?i)^ord-([0-9]+)$"}, "keyword": {"default": "none"}},
    "resolve_params": {"cust": {"index": "people", "from": "name", "optional": True}},
    "request": {"path": "/o/{code}", "query": {"c": "{cust}", "q": "{keyword}", "p": "{page}"}, "omit_empty_query": True},
    "pagination": {"param": "page", "default": "1"},
}


@query("plan_requests", f"""{JOINED}, e AS (SELECT *, CASE WHEN status = 'ambiguous' THEN {ERR} WHEN trim(coalesce(code, '')) = '' THEN 'required param "code" is missing' END AS error FROM j)
  SELECT request_id, 'GET' AS method, CASE WHEN error IS NULL THEN 'https://a.example/o/' || regexp_extract(code, '[0-9]+') || '?' || concat_ws('&', CASE WHEN status = 'ok' THEN 'c=' || v END,
     'p=' || coalesce(nullif(trim(page), ''), '1'), CASE WHEN keyword <> '' THEN 'q=' || {ENC.format('keyword')} END) END AS url,
     CASE WHEN trim(coalesce(cookie, '')) <> '' THEN cookie ELSE 'p=' || coalesce(nullif(trim(page), ''), '1') END AS cookie, error FROM e""")
def plan_requests(spark, sf):
    out = R.plan_requests(rows(spark, sf), TASK, SITE, {"people": index(spark, sf)}, cookie="cookie")
    return out.select("request_id", "method", "url", "cookie", "error")
