"""Knowledge-base enrichment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import derive, query
from webtables.catalog.fixtures import KB_CONTENT, KB_ENTITY, KB_RECORDS, KB_SEARCH, KB_SUMMARY
from webtables.functions import text as X
from webtables.operators import enrich as E

T = f"r AS ({KB_RECORDS}), su AS ({KB_SUMMARY}), se AS ({KB_SEARCH}), en AS ({KB_ENTITY}), co AS ({KB_CONTENT})"
PROBES = f"{T}, p AS (SELECT DISTINCT 'en' AS lang, trim(name) AS query FROM r WHERE trim(name) <> '')"
TOP = f"{PROBES}, top AS (SELECT lang, query, CASE WHEN trim(title) <> '' THEN title ELSE query END AS hit FROM se QUALIFY row_number() OVER (PARTITION BY lang, query ORDER BY rank) = 1)"
MATCH = f"""{TOP}, m AS (SELECT p.lang, p.query, trim(coalesce(s1.entity_id, '')) <> '' AS exact, top.hit,
    CASE WHEN trim(coalesce(s1.entity_id, '')) <> '' THEN s1.title ELSE s2.title END AS title, CASE WHEN trim(coalesce(s1.entity_id, '')) <> '' THEN s1.pageid ELSE s2.pageid END AS pageid,
    CASE WHEN trim(coalesce(s1.entity_id, '')) <> '' THEN s1.entity_id ELSE s2.entity_id END AS entity_id, CASE WHEN trim(coalesce(s1.entity_id, '')) <> '' THEN s1.description ELSE s2.description END AS description,
    CASE WHEN trim(coalesce(s1.entity_id, '')) <> '' THEN s1.page_url ELSE s2.page_url END AS page_url,
    CASE WHEN trim(coalesce(s1.entity_id, '')) <> '' OR s2.title IS NOT NULL THEN NULL WHEN top.hit IS NULL THEN 'not_found' ELSE 'summary_error' END AS reason
  FROM p LEFT JOIN su s1 ON s1.lang = p.lang AND s1.title = p.query LEFT JOIN top ON top.lang = p.lang AND top.query = p.query LEFT JOIN su s2 ON s2.lang = p.lang AND s2.title = top.hit)"""
FULL = f"""{MATCH}, f AS (SELECT m.*, en.entity_id AS e_id, en.birth_date, en.country_qid, en.occupation_qid, en.official_website, co.wikitext FROM m
  LEFT JOIN en ON en.lang = m.lang AND en.title = m.title LEFT JOIN co ON co.lang = m.lang AND co.title = m.title)"""


def tables(spark, sf):
    content = derive(spark, sf, KB_CONTENT).withColumn("external_links", F.array().cast("array<string>"))
    return {
        "summary": derive(spark, sf, KB_SUMMARY), "search": derive(spark, sf, KB_SEARCH),
        "entity": derive(spark, sf, KB_ENTITY), "content": content,
    }


def records(spark, sf):
    return derive(spark, sf, KB_RECORDS)


def probes(spark, sf):
    return E.distinct_probes(records(spark, sf), "name", "en")


def matched(spark, sf):
    t = tables(spark, sf)
    return E.match_with_fallback(probes(spark, sf), t["summary"], t["search"])


@query("kb_distinct_probe", f"WITH {PROBES} SELECT * FROM p")
def kb_distinct_probe(spark, sf):
    return probes(spark, sf)


@query("kb_search_top1", f"WITH {TOP} SELECT lang, query, hit FROM top")
def kb_search_top1(spark, sf):
    return E.search_top1(derive(spark, sf, KB_SEARCH)).withColumnRenamed("hit_title", "hit")


@query("kb_match_with_fallback", f"WITH {MATCH} SELECT query, CASE WHEN reason IS NOT NULL THEN 'none' WHEN exact THEN 'exact' ELSE 'search' END AS how, pageid, title AS accepted_title FROM m")
def kb_match_with_fallback(spark, sf):
    return matched(spark, sf).select("query", "how", F.col("s.pageid").alias("pageid"), "accepted_title")


@query("kb_miss_record", f"WITH {MATCH} SELECT query, reason, false AS matched FROM m WHERE reason IS NOT NULL")
def kb_miss_record(spark, sf):
    m = matched(spark, sf).select(E.miss_record(F.col("query"), F.col("reason")).alias("miss"))
    return m.where(F.col("miss").isNotNull()).select("miss.query", "miss.reason", "miss.matched")


@query("kb_join_entity_content", f"WITH {FULL} SELECT query, title AS accepted_title, e_id, wikitext FROM f")
def kb_join_entity_content(spark, sf):
    t = tables(spark, sf)
    full = E.join_entity_content(matched(spark, sf), t["entity"], t["content"])
    return full.select("query", "accepted_title", F.col("e.entity_id").alias("e_id"), F.col("c.wikitext").alias("wikitext"))


PROFILE_SQL = """CASE WHEN reason IS NULL THEN true END AS matched, CASE WHEN reason IS NULL THEN CASE WHEN trim(coalesce(entity_id, '')) <> '' THEN entity_id ELSE e_id END END AS entity_id, CASE WHEN reason IS NULL THEN 'en' END AS lang,
  title, pageid, page_url, description, CASE WHEN trim(birth_date) <> '' THEN birth_date || '|wikidata|P569' END AS birth, country_qid || '|wikidata|P27' AS country,
  CASE WHEN reason IS NULL THEN CASE WHEN occupation_qid IS NULL THEN '' ELSE occupation_qid || '/P106' END END AS occupation, CASE WHEN trim(official_website) <> '' THEN official_website END AS website, reason AS miss"""


def flat_profile(df, p, miss):
    def prov(c, key):
        return F.concat(c[key], F.lit("|"), c["source"], F.lit("|"), c["property"])

    return df.select(
        *[c for c in df.columns if c not in ("profile", "miss", "meta", "lang", "url", "kb", "image", "name")],
        p["matched"].alias("matched"), p["entity_id"].alias("entity_id"), p["lang"].alias("lang"), p["title"].alias("title"), p["pageid"].alias("pageid"),
        p["url"].alias("page_url"), p["description"].alias("description"), prov(p["profile"]["birth_date"], "value").alias("birth"), prov(p["profile"]["country"], "qid").alias("country"),
        F.array_join(F.transform(p["profile"]["occupation"], lambda o: F.concat(o["qid"], F.lit("/"), o["property"])), ";").alias("occupation"),
        p["social"]["official_website"].alias("website"), miss["reason"].alias("miss"),
    )


@query("kb_profile", f"WITH {FULL} SELECT query, {PROFILE_SQL} FROM f")
def kb_profile(spark, sf):
    out = E.kb_profiles(probes(spark, sf), **tables(spark, sf))
    return flat_profile(out, F.col("profile"), F.col("miss"))


@query("kb_provenance", f"WITH {T} SELECT title, CASE WHEN trim(birth_date) <> '' THEN birth_date || '|wikidata|P569' END AS birth, CASE WHEN occupation_qid IS NOT NULL THEN occupation_qid || '|wikidata|P106' END AS occupation FROM en")
def kb_provenance(spark, sf):
    def flat(c, prop, key):
        p = E.provenance(c, prop, key)
        return F.concat_ws("|", p[key], p["source"], p["property"])

    e = derive(spark, sf, KB_ENTITY)
    return e.select(
        "title",
        F.nullif(flat(F.col("birth_date"), "P569", "value"), F.lit("")).alias("birth"),
        F.nullif(flat(F.col("occupation_qid"), "P106", "qid"), F.lit("")).alias("occupation"),
    )


@query("blank_to_null", f"WITH {T} SELECT title, CASE WHEN trim(birth_date) <> '' THEN birth_date END AS birth, CASE WHEN official_website <> '' THEN official_website END AS website FROM en")
def blank_to_null(spark, sf):
    return derive(spark, sf, KB_ENTITY).select("title", X.blank_to_null(F.col("birth_date")).alias("birth"), X.blank_to_null(F.col("official_website")).alias("website"))


@query("kb_attach", f"WITH {FULL}, fp AS (SELECT query, {PROFILE_SQL} FROM f) SELECT rec_id, r.image AS old_image, fp.* EXCLUDE (query) FROM r LEFT JOIN fp ON trim(r.name) = fp.query")
def kb_attach(spark, sf):
    rec = records(spark, sf)
    profiles = E.kb_profiles(E.distinct_probes(rec, "name", "en"), **tables(spark, sf))
    out = E.kb_attach(rec, profiles, ["rec_id"], lang="en").withColumn("old_image", F.col("image"))
    return flat_profile(out, F.col("kb.profile"), F.col("kb.miss"))


@query("kb_attach_list", f"WITH {FULL} SELECT rec_id, coalesce(CAST(f.pageid AS VARCHAR), f.reason, '-') || '|n' AS ids FROM r LEFT JOIN f ON trim(r.name) = f.query")
def kb_attach_list(spark, sf):
    rec = records(spark, sf)
    lists = rec.select("rec_id", F.array(F.struct("name", "image"), F.struct(F.lit(" ").alias("name"), F.col("image"))).alias("people"))
    profiles = E.kb_profiles(E.distinct_probes(rec, "name", "en"), **tables(spark, sf))
    out = E.kb_attach(lists, profiles, ["rec_id"], lang="en", items="people")

    def label(p):
        return F.coalesce(p["kb"]["profile"]["pageid"].cast("string"), p["kb"]["miss"]["reason"], F.when(F.trim(p["name"]) == "", F.lit("n")), F.lit("-"))

    first = F.when(F.trim(F.col("people")[0]["name"]) == "", F.lit("-")).otherwise(label(F.col("people")[0]))
    return out.select("rec_id", F.concat(first, F.lit("|"), label(F.col("people")[1])).alias("ids"))


@query("kb_result_meta", f"""WITH {FULL}, q AS (SELECT rec_id, trim(name) AS query FROM r) SELECT rec_id, CASE WHEN q.query = '' THEN 'param_error' WHEN reason IS NOT NULL THEN 'summary_error' END AS error,
   CASE WHEN pageid > 0 THEN pageid END AS pageid, CASE WHEN trim(entity_id) <> '' THEN entity_id END AS entity_id, page_url AS url FROM q LEFT JOIN f ON f.query = q.query""")
def kb_result_meta(spark, sf):
    """Stand-alone profile requests: language and title defaults, error rows, result meta."""
    rec = records(spark, sf).select("rec_id", F.lit(" ").alias("lang"), F.lit(None).cast("string").alias("title"), F.trim("name").alias("name"))
    req = E.profile_requests(rec, "en")
    out = E.profile_results(req, ["rec_id"], **tables(spark, sf))
    return out.select("rec_id", F.col("error.type").alias("error"), "meta.pageid", "meta.entity_id", "url")
