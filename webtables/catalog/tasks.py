"""Whole tasks: the usual shapes composed from the operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import LINKS, absolute, decoded, derive, query, table
from webtables.catalog.enrich import FULL, records, tables
from webtables.catalog.fixtures import INDEX, JSON_ORDERS
from webtables.catalog.html import pages
from webtables.catalog.jsonx import HITS
from webtables.catalog.listing import BUILT, record_list
from webtables.catalog.lookup import IMAGES, images
from webtables.functions import select as S
from webtables.operators import enrich as E
from webtables.operators import listing as L
from webtables.operators.params import plan_requests
from webtables.operators.wikitext import WikiSpec, text_record
from webtables.plans.scratch import write_then_read
from webtables.plans.spec import ALL, Extract, Field
from webtables.plans.task import run_task
from webtables.sources.index import index_from_items
from webtables.sources.pages import spread_rows

TITLE = decoded(decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)"))
N_LINKS = "CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT)"
LINK = S.child("a")
SITE = {"base_url": "https://a.example/"}
KB_SPEC = WikiSpec(infobox="Infobox item", text_fields={"name": ["name"]}, sections={"resume": ["History"]}, link_sections=["Links"])


def responses(spark, sf, status=None):
    p = pages(spark, sf)
    return p.select(
        F.col("page_id").alias("request_id"), F.lit("demo").alias("site"), F.lit("t").alias("task"),
        (F.lit(200) if status is None else status).cast("int").alias("status"), F.col("url").alias("final_url"),
        F.create_map().cast("map<string,string>").alias("headers"), F.col("html").alias("body"),
        F.lit("http").alias("channel"), F.lit(None).cast("string").alias("fetch_error"),
    )


def param_rows(spark, sf):
    """One parameter row per page: the page number is blank, absent or given."""
    k = F.col("page_id") % 3
    page = F.when(k == 0, " ").when(k == 1, F.col("page_id").cast("string"))
    base = F.create_map(F.lit("code"), F.concat(F.lit(" id-"), F.col("page_id").cast("string")))
    both = F.create_map(F.lit("code"), F.concat(F.lit(" id-"), F.col("page_id").cast("string")), F.lit("page"), page)
    p = table(spark, sf, "pages")
    return p.select(F.col("page_id").alias("request_id"), F.when(page.isNull(), base).otherwise(both).alias("params"))


LIST_TASK = {
    "params": {"code": {"required": True, "regex": "^id-([0-9]+)$"}},
    "request": {"path": "/l/{code}", "query": {"page": "{page}"}},
    "pagination": {"param": "page", "default": "1", "total_field": "n"},
    "extract": Extract(
        scope=S.descendant("li"),
        fields={"name": Field(LINK), "href": Field(LINK, attr="href", resolve_url=True)},
        meta={"n": Field(S.descendant("html"), attr="lang")},
    ),
    "output": {"type": "list", "format": {"n": "{name}", "u": "{href}"}},
}
PAGE_NUM = "CASE page_id % 3 WHEN 1 THEN page_id ELSE 1 END"


@query("task_list_page", f"""SELECT page_id AS request_id, true AS ok, 'https://a.example/l/' || page_id || '?page=' || {PAGE_NUM} AS url, {N_LINKS} AS count, CAST({PAGE_NUM} AS BIGINT) AS page,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS total, {N_LINKS} AS n_items FROM pages""")
def task_list_page(spark, sf):
    plan = plan_requests(param_rows(spark, sf), LIST_TASK, SITE)
    out = run_task(responses(spark, sf), LIST_TASK, plan)
    return out.select("request_id", "ok", "url", "meta.count", "meta.page", "meta.total", F.size("data").cast("bigint").alias("n_items"))


DETAIL_TASK = {
    "extract": Extract(fields={
        "title": Field(S.descendant("title")), "first": Field(S.descendant("li").child("a")),
        "all": Field(S.descendant("li").child("a"), multiple=True), "missing": Field(S.descendant("table"), multiple=True),
    }),
    "output": {"type": "object", "format": {"title": "{title}", "links": {"first": "{first}", "all": "{all}"}, "none": "{missing}"}},
}


@query("task_detail_page", f"""WITH {LINKS}, a AS (SELECT page_id, string_agg(txt, '|' ORDER BY pos) AS al, min(txt) FILTER (pos = 0) AS f FROM links GROUP BY page_id)
  SELECT p.page_id AS request_id, {TITLE} AS title, f AS first, coalesce(al, '') AS all_links, CAST(0 AS BIGINT) AS n_none FROM pages p LEFT JOIN a USING (page_id)""")
def task_detail_page(spark, sf):
    out = run_task(responses(spark, sf), DETAIL_TASK)
    return out.select("request_id", "data.title", "data.links.first", F.array_join("data.links.all", "|").alias("all_links"), F.size("data.none").cast("bigint").alias("n_none"))


HEADER_TASK = {
    "params": {"actor": {"required": True}},
    "resolve_params": {"star": {"index": "people", "from": "actor"}},
    "request": {"path": "/star/{star}"},
    "extract": Extract(
        scope=S.descendant("li"),
        fields={"name": Field(LINK), "image": Field(LINK, attr="href")},
        page={"head": Field(S.descendant("h1"))},
        meta={"lang": Field(S.descendant("html"), attr="lang")},
    ),
    "output": {"format": {"name": "{name}", "image": "{image}"}, "page_format": {"title": "{head}"}, "items_key": "people"},
    "enhance": {"image_field": "image", "kb_field": "kb", "lang": "en"},
}
PEOPLE_SITE = {**SITE, "indexes": {"people": {"match_field": "name", "value_field": "id"}}}
ACTOR = "CASE page_id % 4 WHEN 3 THEN 'no such' WHEN 2 THEN CASE WHEN page_id % 8 = 2 THEN ' ' ELSE NULL END ELSE concat(' customer#', lpad(CAST(page_id % 140 + 1 AS STRING), 9, '0')) END"
# Link texts are looked up among words of part names.
WORDS = "SELECT name, concat('img/', max(p_partkey)) AS url FROM (SELECT split_part(p_name, ' ', 1) AS name, p_partkey FROM part UNION ALL SELECT 'the', p_partkey FROM part) w GROUP BY name"


# Knowledge base about two words. One has no entity of its own; searches lead to the other, or nowhere.
WORD_KB = """SELECT 'en' AS lang, CASE n_nationkey % 2 WHEN 0 THEN 'the' ELSE 'and' END AS title, max(CAST(n_nationkey AS BIGINT)) AS pageid,
  CASE n_nationkey % 2 WHEN 0 THEN 'Wthe' ELSE ' ' END AS entity_id FROM nation GROUP BY n_nationkey % 2"""
WORD_SEARCH = """SELECT 'en' AS lang, CASE n_nationkey % 3 WHEN 0 THEN 'and' WHEN 1 THEN 'of' ELSE 'to' END AS query, n_nationkey AS rank,
  CASE WHEN n_nationkey % 3 = 2 THEN 'ghost' WHEN n_nationkey < 3 THEN 'the' ELSE 'nowhere' END AS title FROM nation"""
WORD_ENTITY = "SELECT 'en' AS lang, 'the' AS title, concat('E', CAST(max(n_nationkey) AS STRING)) AS entity_id, concat('QN', CAST(count(*) AS STRING)) AS country_qid FROM nation"
WORD_CONTENT = "SELECT 'en' AS lang, 'the' AS title, concat('{{Infobox item\n|name = N', CAST(count(*) AS STRING), '\n}}\nIntro of [[x|', min(n_name), ']]\n== Links ==\n* plain\n') AS wikitext FROM nation"
WORD_MATCH = f"""su AS ({WORD_KB}), se AS ({WORD_SEARCH}), en AS ({WORD_ENTITY}), co AS ({WORD_CONTENT}),
  top AS (SELECT query, arg_min(title, rank) AS hit FROM se GROUP BY query), w AS (SELECT DISTINCT txt FROM links),
  m AS (SELECT txt, coalesce(trim(s1.entity_id), '') <> '' AS exact, s1.entity_id AS own, s2.title AS t2, s2.entity_id AS id2, top.hit FROM w
    LEFT JOIN su s1 ON s1.title = txt LEFT JOIN top ON top.query = txt LEFT JOIN su s2 ON s2.title = top.hit),
  kb AS (SELECT txt, CASE WHEN exact THEN own WHEN t2 IS NOT NULL THEN coalesce(nullif(trim(id2), ''), en.entity_id, '') WHEN hit IS NULL THEN 'not_found' ELSE 'summary_error' END
      || '/' || coalesce(en.country_qid, '') AS short, CASE WHEN co.title IS NULL THEN '' ELSE 'Intro of ' || regexp_extract(co.wikitext, 'x[|]([^]]+)[]][]]', 1) || '+' || regexp_extract(co.wikitext, 'N[0-9]+') END AS text
    FROM m LEFT JOIN en ON en.title = CASE WHEN exact THEN txt ELSE t2 END LEFT JOIN co ON co.title = CASE WHEN exact THEN txt ELSE t2 END)"""


def word_kb(spark, sf):
    """The tables of the knowledge base about words."""
    content = derive(spark, sf, WORD_CONTENT).withColumn("external_links", F.array().cast("array<string>"))
    return {"summary": derive(spark, sf, WORD_KB), "search": derive(spark, sf, WORD_SEARCH), "entity": derive(spark, sf, WORD_ENTITY), "content": content}


def kb_label(kb):
    """entity id or reason / country."""
    p = kb["profile"]
    return F.concat_ws("/", F.coalesce(p["entity_id"], kb["miss"]["reason"]), F.coalesce(p["profile"]["country"]["qid"], F.lit("")))


def kb_text(kb):
    """Introduction + name in the infobox of the page's wikitext."""
    text = kb["profile"]["text"]
    return F.coalesce(F.concat(text["intro"], F.lit("+"), text["profile"]["name"]), F.lit(""))


@query("task_header_and_items", f"""WITH {LINKS}, i AS ({WORDS}), {WORD_MATCH}, ix AS ({INDEX}), q AS (SELECT page_id, lower(trim({ACTOR})) AS actor FROM pages),
  r AS (SELECT q.page_id, CASE WHEN coalesce(actor, '') = '' OR trim(coalesce(ix.id, '')) = '' THEN 'param_error' END AS error, 'https://a.example/star/' || trim(ix.id) AS url FROM q LEFT JOIN ix ON lower(ix.name) = actor),
  a AS (SELECT page_id, string_agg(coalesce(i.url, href) || ':' || kb.short, '|' ORDER BY pos) AS v FROM links LEFT JOIN i ON i.name = txt LEFT JOIN kb USING (txt) GROUP BY page_id)
  SELECT p.page_id AS request_id, error, CASE WHEN error IS NULL THEN r.url END AS url, CASE WHEN error IS NULL THEN {decoded(decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} END AS title,
    CASE WHEN error IS NULL THEN coalesce(v, '') END AS people, CASE WHEN error IS NULL THEN regexp_extract(html, '<html lang="([^"]*)"', 1) END AS lang FROM pages p JOIN r USING (page_id) LEFT JOIN a USING (page_id)""")
def task_header_and_items(spark, sf):
    actors = derive(spark, sf, f"SELECT page_id AS request_id, {ACTOR} AS actor FROM pages")
    params = F.when(F.col("actor").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("actor"), F.col("actor")))
    plan = plan_requests(actors.select("request_id", params.alias("params")), HEADER_TASK, PEOPLE_SITE, {"people": derive(spark, sf, INDEX)})
    out = run_task(responses(spark, sf), HEADER_TASK, plan, lookup=derive(spark, sf, WORDS), kb=word_kb(spark, sf))
    people = F.transform("data.people", lambda p: F.concat(p["image"], F.lit(":"), kb_label(p["kb"])))
    return out.select("request_id", F.col("error.type").alias("error"), "url", "data.title", F.array_join(people, "|").alias("people"), "meta.lang")


SEARCH_TASK = {
    "request": {"accept_status": [404]},
    "extract": Extract(scope=S.descendant("li"), fields={"name": Field(LINK), "image": Field(LINK, attr="href")}),
    "output": {"type": "list", "format": {"name": "{name}", "image": "{image}"}},
    "enhance": {"kb_field": "kb", "lang": "en", "image_field": "image", "wikitext": KB_SPEC},
}
@query("task_candidate_search", f"""WITH {LINKS}, i AS ({WORDS}), {WORD_MATCH}, a AS (SELECT page_id, string_agg(coalesce(i.url, href) || ':' || kb.short || '/' || kb.text, '|' ORDER BY pos) AS v FROM links LEFT JOIN i ON i.name = txt LEFT JOIN kb USING (txt) GROUP BY page_id)
  SELECT p.page_id AS request_id, CASE p.page_id % 3 WHEN 2 THEN 'http_error' END AS error, CASE p.page_id % 3 WHEN 2 THEN NULL ELSE coalesce(v, '') END AS items FROM pages p LEFT JOIN a USING (page_id)""")
def task_candidate_search(spark, sf):
    status = F.when(F.col("page_id") % 3 == 1, 404).when(F.col("page_id") % 3 == 2, 500).otherwise(200)
    out = run_task(responses(spark, sf, status), SEARCH_TASK, lookup=derive(spark, sf, WORDS), kb=word_kb(spark, sf))
    item = F.transform("data", lambda d: F.concat(d["image"], F.lit(":"), kb_label(d["kb"]), F.lit("/"), kb_text(d["kb"])))
    return out.select("request_id", "error.type", F.when(F.col("ok"), F.array_join(item, "|")).alias("items")).withColumnRenamed("type", "error")


@query("task_paged_directory", f"WITH {BUILT}, x AS (SELECT page, count(*) AS n, min(pos) AS first_pos FROM m GROUP BY page) SELECT page, n, first_pos FROM x")
def task_paged_directory(spark, sf):
    data = record_list(pages(spark, sf))
    listing = data.select("page", F.lit(0).alias("attempt"), F.lit(True).alias("ok"), F.col("data.links").alias("items"))
    rows, header, missing = L.build_index(write_then_read(listing, "listing"))
    L.require_complete(header, missing)
    return rows.groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.min("pos").cast("bigint").alias("first_pos"))


CATEGORIES = [{"name": "News", "fid": "50"}, {"name": "Talk", "fid": "10"}, {"name": "Help", "fid": "20"}]
THREAD_TASK = {
    "params": {"category": {}},
    "resolve_params": {"fid": {"index": "categories", "from": "category", "match_field": "name", "value_field": "fid", "optional": True}},
    "request": {"path": "/forum", "query": {"fid": "{fid}", "page": "{page}"}, "omit_empty_query": True},
    "pagination": {"param": "page", "default": "1", "total_field": "total"},
    "extract": Extract(
        scope=S.descendant("li"),
        fields={"title": Field(LINK, trim=True), "url": Field(LINK, attr="href", resolve_url=True)},
        page={"board": Field(S.descendant("h1"), trim=True)},
        meta={"total": Field(S.descendant("script"), regex=r"track\(([0-9]+)\)", type="int")},
    ),
    "output": {"format": {"title": "{title}", "url": "{url}"}, "page_format": {"board": "{board}"}, "items_key": "threads"},
}
CATEGORY = "CASE page_id % 6 WHEN 0 THEN ' news' WHEN 1 THEN 'TALK ' WHEN 2 THEN 'Help' WHEN 3 THEN 'no such' WHEN 4 THEN ' ' END"
THREAD_PAGE = "CASE page_id % 4 WHEN 1 THEN CAST(page_id % 9 AS STRING) WHEN 2 THEN ' ' END"


@query("task_category_filter", f"""WITH {LINKS}, q AS (SELECT page_id, coalesce(nullif(trim({THREAD_PAGE}), ''), '1') AS page, CASE page_id % 6 WHEN 0 THEN 'fid=50&' WHEN 1 THEN 'fid=10&' WHEN 2 THEN 'fid=20&' ELSE '' END AS fid FROM pages),
  a AS (SELECT page_id, count(*) AS n, string_agg(trim(txt) || '=' || {absolute('url', 'href')}, '|' ORDER BY pos) AS threads FROM links GROUP BY page_id)
  SELECT p.page_id AS request_id, 'https://a.example/forum?' || fid || 'page=' || page AS url, trim({decoded(decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))}) AS board, CAST(coalesce(n, 0) AS BIGINT) AS count,
    CAST(page AS BIGINT) AS page, CASE WHEN regexp_matches(html, '<script>.*track\\(([0-9]+)\\)') THEN CAST(regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS BIGINT) END AS total, coalesce(threads, '') AS threads
  FROM pages p JOIN q USING (page_id) LEFT JOIN a USING (page_id)""")
def task_category_filter(spark, sf):
    given = derive(spark, sf, f"SELECT page_id AS request_id, {CATEGORY} AS category, {THREAD_PAGE} AS page FROM pages")
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in ("category", "page")]), lambda e: e["v"].isNotNull())
    ix = index_from_items(spark, CATEGORIES, "name string, fid string")
    plan = plan_requests(given.select("request_id", F.map_from_entries(entries).alias("params")), THREAD_TASK, SITE, {"categories": ix})
    out = run_task(responses(spark, sf), THREAD_TASK, plan)
    threads = F.array_join(F.transform("data.threads", lambda t: F.concat(t["title"], F.lit("="), t["url"])), "|")
    return out.select("request_id", "url", "data.board", "meta.count", "meta.page", "meta.total", threads.alias("threads"))


POST_TASK = {
    "extract": Extract(fields={
        "body": Field(S.descendant("nav"), attr="html"),
        "links": Field(S.descendant("a"), attr="href", multiple=True, resolve_url=True),
        "words": Field(S.descendant("li"), regex="[a-z]+", multiple=True),
        "outer": Field(S.descendant("div").first(), attr="outer_html", regex=r'class="([a-z]+)"'),
    }),
    "output": {"type": "object", "format": {"html": "{body}", "links": "{links}", "words": "{words}", "css": "{outer}"}},
}


@query("task_thread_detail", f"""WITH {LINKS}, a AS (SELECT page_id, string_agg({absolute('url', 'href')}, ' ' ORDER BY pos) AS l, CAST(sum(len(regexp_extract_all(txt, '[a-z]+'))) AS BIGINT) AS w FROM links GROUP BY page_id)
  SELECT p.page_id AS request_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS html, coalesce(l, '') AS links, coalesce(w, 0) AS n_words, 'ad' AS css FROM pages p LEFT JOIN a USING (page_id)""")
def task_thread_detail(spark, sf):
    out = run_task(responses(spark, sf), POST_TASK)
    return out.select("request_id", "data.html", F.array_join("data.links", " ").alias("links"), F.size("data.words").cast("bigint").alias("n_words"), "data.css")


JSON_TASK = {
    "extract": Extract(
        type="json", scope=("query", "search", ALL),
        fields={"title": Field(path=("title",), trim=True), "id": Field(path=("pageid",), type="int")},
        meta={"total": Field(path=("query", "total"), type="int")},
    ),
    "output": {"format": {"id": "{id}", "label": "{title} #{id}"}, "items_key": "items"},
}


@query("task_json_search", f"""WITH {HITS}, a AS (SELECT doc_id, string_agg(trim(coalesce(title, '')) || ' #' || pageid, '|' ORDER BY pos) AS labels FROM h GROUP BY doc_id)
  SELECT j.doc_id AS request_id, CASE WHEN g.doc_id IS NULL THEN 'extract_error' END AS error, CAST(g.ck % 7 AS BIGINT) AS total, labels FROM j LEFT JOIN g USING (doc_id) LEFT JOIN a USING (doc_id)""")
def task_json_search(spark, sf):
    j = spread_rows(derive(spark, sf, JSON_ORDERS), "doc_id")
    r = j.select(
        F.col("doc_id").alias("request_id"), F.lit("demo").alias("site"), F.lit("t").alias("task"), F.lit(200).alias("status"), F.lit("https://a.example").alias("final_url"),
        F.create_map().cast("map<string,string>").alias("headers"), "body", F.lit("http").alias("channel"), F.lit(None).cast("string").alias("fetch_error"),
    )
    out = run_task(r, JSON_TASK)
    return out.select("request_id", F.col("error.type").alias("error"), "meta.total", F.array_join(F.transform("data.items", lambda i: i["label"]), "|").alias("labels"))


@query("task_direct_lookup", f"""WITH r AS (SELECT o_orderkey AS request_id, CASE o_orderstatus WHEN 'P' THEN ' ' ELSE concat(' Supplier#', lpad(CAST(o_custkey % 150 AS VARCHAR), 9, '0')) END AS name FROM orders), i AS ({IMAGES})
  SELECT request_id, CASE WHEN trim(i.url) <> '' THEN i.url END AS image, CASE WHEN trim(r.name) = '' THEN 'param_error' WHEN i.url IS NULL OR trim(i.url) = '' THEN 'not_found' END AS error FROM r LEFT JOIN i ON i.name = trim(r.name)""")
def task_direct_lookup(spark, sf):
    from webtables.operators.lookup import lookup_or_not_found

    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit(" Supplier#"), F.lpad((F.col("o_custkey") % 150).cast("string"), 9, "0")))
    out = lookup_or_not_found(o.select(F.col("o_orderkey").alias("request_id"), name.alias("name")), images(spark, sf))
    return out.select("request_id", "image", F.col("error.type").alias("error"))


# Pages of the knowledge base with an infobox, a section and a link.
KB_PAGES = """SELECT 'en' AS lang, CASE WHEN c_mktsegment = 'BUILDING' THEN concat('Page ', c_name) ELSE c_name END AS title,
  concat('{{Infobox item\n|name = ', c_name, '\n}}\nIntro of [[x|', c_name, ']]<br/>next\n== History ==\n', c_mktsegment, ' [[since]]\n== Links ==\n* [https://a.example/', CAST(c_custkey AS STRING), ' Site]\n') AS wikitext,
  c_name AS own, c_mktsegment AS segment FROM customer"""


@query("task_profile_by_title", f"""WITH {FULL}, tx AS ({KB_PAGES}) SELECT rec_id, CASE WHEN trim(r.name) = '' THEN 'param_error' WHEN f.reason IS NOT NULL THEN 'summary_error' END AS error,
  CASE WHEN f.reason IS NULL THEN CASE WHEN trim(coalesce(f.entity_id, '')) <> '' THEN f.entity_id ELSE f.e_id END END AS entity_id, f.title, CASE WHEN f.pageid > 0 THEN f.pageid END AS pageid, f.page_url AS url,
  CASE WHEN trim(f.birth_date) <> '' THEN f.birth_date || '|wikidata|P569' END AS birth, 'Intro of ' || tx.own || chr(10) || 'next' AS intro, tx.own AS box_name, tx.segment || ' since' AS resume,
  CASE WHEN tx.own IS NOT NULL THEN 'Site' END AS link
  FROM r LEFT JOIN f ON trim(r.name) = f.query LEFT JOIN tx ON tx.title = f.title""")
def task_profile_by_title(spark, sf):
    rec = records(spark, sf).select("rec_id", F.lit(None).cast("string").alias("lang"), F.lit(" ").alias("title"), "name")
    content = derive(spark, sf, KB_PAGES).select("lang", "title", "wikitext").withColumn("external_links", F.array().cast("array<string>"))
    out = E.profile_results(
        E.profile_requests(rec, "en"), ["rec_id"], **{**tables(spark, sf), "content": content},
        text=lambda c: text_record(c["wikitext"], c["external_links"], KB_SPEC),
    )
    p = F.col("profile")
    born = p["profile"]["birth_date"]
    return out.select(
        "rec_id", F.col("error.type").alias("error"), p["entity_id"].alias("entity_id"), p["title"].alias("title"), "meta.pageid", "url",
        F.concat(born["value"], F.lit("|"), born["source"], F.lit("|"), born["property"]).alias("birth"),
        p["text"]["intro"].alias("intro"), p["text"]["profile"]["name"].alias("box_name"), p["text"]["resume"].alias("resume"),
        F.get(p["text"]["external_links"], F.lit(0))["label"].alias("link"),
    )
