"""Enrichment from knowledge-base tables with fallback and provenance.

Tables: ``summary``, ``entity``, ``content`` hold one row per (lang, title); ``search`` holds ranked
hits per (lang, query). Every distinct title is looked up once and the result is joined back, so a
title that fills a third of the records costs one lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions import text as X
from webtables.operators.lookup import join_list
from webtables.plans.skew import keyed_join

DEFAULT_LANG = "zh"
SOURCE = "wikidata"
# Knowledge-base property ids of the profile fields.
PROPERTIES = {
    "birth_date": ("birth_date", "P569", "value"),
    "birth_place": ("birth_place_qid", "P19", "qid"),
    "height_cm": ("height_cm", "P2048", "value"),
    "country": ("country_qid", "P27", "qid"),
    "occupation": ("occupation_qid", "P106", "qid"),
}

SUMMARY_COLS = {
    "title": "string", "pageid": "bigint", "entity_id": "string", "lang": "string", "description": "string",
    "summary": "string", "page_url": "string", "thumbnail": "string", "revision": "string", "timestamp": "string",
}
ENTITY_COLS = {
    "entity_id": "string", "zh_title": "string", "ja_title": "string", "en_title": "string", "birth_date": "string",
    "birth_place_qid": "string", "height_cm": "string", "country_qid": "string", "occupation_qid": "string",
    "x_username": "string", "instagram_username": "string", "official_website": "string", "imdb_id": "string",
    "commons_category": "string", "entity_image": "string",
}


def distinct_probes(records: DataFrame, title: str, lang: Column | str | None = None) -> DataFrame:
    """Each (lang, trimmed title) once; blanks skipped."""
    language = F.coalesce(X.blank_to_null(lang if isinstance(lang, Column) else F.lit(lang)), F.lit(DEFAULT_LANG))
    return (
        records.select(language.alias("lang"), X.trim_ws(F.col(title)).alias("query"))
        .where(F.col("query") != "")
        .distinct()
    )


def search_top1(search: DataFrame) -> DataFrame:
    """First hit per (lang, query): its title, or the query when the hit has none."""
    return (
        search.groupBy("lang", "query")
        .agg(F.min_by(F.struct("title"), F.col("rank")).alias("h"))
        .select("lang", "query", X.first_non_blank(F.col("h.title"), F.col("query")).alias("hit_title"))
    )


def _packed(table: DataFrame, cols: dict[str, str], name: str, title: str = "title") -> DataFrame:
    """(lang, title, one struct) with every expected column, NULL where the table lacks it."""
    parts = [(F.col(c) if c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()]
    return table.select(F.col("lang").alias("_lang"), F.col(title).alias("_title"), F.struct(*parts).alias(name))


def _title_key(title: str) -> Column:
    return F.when(F.col(title).isNotNull(), F.concat_ws("\u0001", "lang", title))


def _join_title(left: DataFrame, right: DataFrame, title: str) -> DataFrame:
    """Left join on (lang, title). Probes are distinct, but many may fall back to one title."""
    keyed = left.withColumn("_k", _title_key(title))
    table = right.withColumn("_k", F.concat_ws("\u0001", "_lang", "_title")).drop("_lang", "_title")
    return keyed_join(keyed, table, "_k").drop("_k")


def match_with_fallback(probes: DataFrame, summary: DataFrame, search: DataFrame, key: str = "title") -> DataFrame:
    """Probes (lang, query) + ``s`` (summary struct), ``how``, ``accepted_title``, ``reason``.

    Exact summary when it has a non-blank entity id; else the first search hit's summary, where the
    id is not required. ``key`` is the summary column that answers a title request.
    """
    packed = _packed(summary, SUMMARY_COLS, "s1", key)
    first = _join_title(probes.withColumn("_q", F.col("query")), packed, "_q").drop("_q")
    exact = ~X.is_blank(F.col("s1.entity_id"))
    top = search_top1(search)
    fallen = first.withColumn("exact", exact).join(top, ["lang", "query"], "left")
    fallen = fallen.withColumn("_hit", F.when(~F.col("exact"), F.col("hit_title")))
    second = _join_title(fallen, packed.withColumnRenamed("s1", "s2"), "_hit")
    s = F.when(F.col("exact"), F.col("s1")).otherwise(F.col("s2"))
    how = (
        F.when(F.col("exact"), "exact")
        .when(F.col("hit_title").isNull(), "none")
        .when(F.col("s2").isNotNull(), "search")
        .otherwise("none")
    )
    reason = F.when(F.col("exact") | F.col("s2").isNotNull(), None).when(F.col("hit_title").isNull(), "not_found").otherwise("summary_error")
    return second.select("lang", "query", "hit_title", s.alias("s"), how.alias("how"), reason.cast("string").alias("reason")).withColumn(
        "accepted_title", F.when(F.col("how") != "none", X.first_non_blank(F.col("s.title"), F.col("query")))
    )


def miss_record(query: Column, reason: Column) -> Column:
    """``{matched: false, query, reason}`` where there is a reason."""
    return F.when(reason.isNotNull(), F.struct(F.lit(False).alias("matched"), query.alias("query"), reason.alias("reason")))


def join_entity_content(matched: DataFrame, entity: DataFrame, content: DataFrame) -> DataFrame:
    """Best-effort entity and content rows of the accepted title; absence is fine."""
    e = _packed(entity, ENTITY_COLS, "e")
    c = _packed(content, {"wikitext": "string", "external_links": "array<string>"}, "c")
    return _join_title(_join_title(matched, e, "accepted_title"), c, "accepted_title")


def provenance(value: Column, prop: str, key: str = "value", source: str = SOURCE) -> Column:
    """Present value → ``{value|qid, source, property}``, else NULL. Blank strings are not present."""
    present = value.isNotNull() & (X.trim_ws(value.cast("string")) != "")
    return F.when(present, F.struct(value.alias(key), F.lit(source).alias("source"), F.lit(prop).alias("property")))


def profile_record(query: Column, lang: Column, s: Column, e: Column, text: Column | None = None) -> Column:
    """Nested profile of one matched title."""
    prov = {out: provenance(e[col], prop, key) for out, (col, prop, key) in PROPERTIES.items()}
    occupation = F.when(prov["occupation"].isNotNull(), F.array(prov["occupation"])).otherwise(
        F.array().cast("array<struct<qid:string,source:string,property:string>>")
    )
    parts = [
        F.lit(True).alias("matched"),
        query.alias("query"),
        X.first_non_blank(s["lang"], lang).alias("lang"),
        s["title"].alias("title"),
        s["pageid"].alias("pageid"),
        s["page_url"].alias("url"),
        X.first_non_blank(s["entity_id"], e["entity_id"]).alias("entity_id"),
        s["description"].alias("description"),
        s["summary"].alias("summary"),
        s["thumbnail"].alias("thumbnail"),
        s["revision"].alias("revision"),
        s["timestamp"].alias("timestamp"),
        F.struct(e["zh_title"].alias("zh"), e["ja_title"].alias("ja"), e["en_title"].alias("en")).alias("languages"),
        F.struct(*[prov[k].alias(k) for k in ("birth_date", "birth_place", "height_cm", "country")], occupation.alias("occupation")).alias("profile"),
        F.struct(
            X.blank_to_null(e["x_username"]).alias("x"),
            X.blank_to_null(e["instagram_username"]).alias("instagram"),
            X.blank_to_null(e["official_website"]).alias("official_website"),
            X.blank_to_null(e["imdb_id"]).alias("imdb_id"),
        ).alias("social"),
        F.struct(
            X.blank_to_null(e["commons_category"]).alias("commons_category"),
            X.blank_to_null(e["entity_image"]).alias("entity_image"),
            X.blank_to_null(s["thumbnail"]).alias("summary_thumbnail"),
        ).alias("media"),
    ]
    if text is not None:
        parts.append(text.alias("text"))
    return F.struct(*parts)


def kb_profiles(probes: DataFrame, summary: DataFrame, search: DataFrame, entity: DataFrame, content: DataFrame, text=None, key: str = "title") -> DataFrame:
    """(lang, query) → ``profile`` (NULL on a miss), ``miss``, ``meta``, ``url``.

    ``text``: optional column builder over the content struct (see ``operators.wikitext``).
    """
    full = join_entity_content(match_with_fallback(probes, summary, search, key), entity, content)
    ok = F.col("reason").isNull()
    t = text(F.col("c")) if text else None
    return full.select(
        "lang",
        "query",
        F.when(ok, profile_record(F.col("query"), F.col("lang"), F.col("s"), F.col("e"), t)).alias("profile"),
        miss_record(F.col("query"), F.col("reason")).alias("miss"),
        result_meta(F.col("s")).alias("meta"),
        F.when(ok, X.blank_to_null(F.col("s.page_url"))).alias("url"),
    )


def result_meta(s: Column) -> Column:
    """Page id if a positive integer, entity id if not blank; NULL when neither is there."""
    pageid, eid = F.when(s["pageid"] > 0, s["pageid"]), X.blank_to_null(s["entity_id"])
    return F.when(pageid.isNotNull() | eid.isNotNull(), F.struct(pageid.alias("pageid"), eid.alias("entity_id")))


def profile_requests(requests: DataFrame, default_lang: str = "") -> DataFrame:
    """Stand-alone profile task: language and title of each request; a blank title is an error row."""
    lang = X.first_non_blank(F.col("lang"), F.lit(default_lang), F.lit(DEFAULT_LANG))
    title = X.first_non_blank(F.col("title"), F.col("name"))
    error = F.when(X.is_blank(title), F.struct(F.lit("param_error").alias("type"), F.lit("title is required").alias("reason")))
    return requests.withColumn("lang", lang).withColumn("title", title).withColumn("error", error)


def profile_results(requests: DataFrame, row_id: list[str], summary: DataFrame, search: DataFrame, entity: DataFrame, content: DataFrame, text=None) -> DataFrame:
    """Requests of ``profile_requests`` → ``profile``, ``meta``, ``url``, ``error``.

    Both kinds of miss are one ``summary_error`` here.
    """
    probes = requests.where(F.col("error").isNull()).select("lang", X.trim_ws(F.col("title")).alias("query")).distinct()
    found = kb_profiles(probes, summary, search, entity, content, text)
    right = found.select(F.concat_ws("\u0001", "lang", "query").alias("_k"), F.struct("profile", "meta", "url").alias("_r"))
    left = requests.withColumn("_k", F.when(F.col("error").isNull(), F.concat_ws("\u0001", F.col("lang"), X.trim_ws(F.col("title")))))
    out = keyed_join(left, right, "_k")
    missed = F.col("_r.profile").isNull()
    error = F.coalesce(
        "error",
        F.when(missed, F.struct(F.lit("summary_error").alias("type"), F.lit("unable to load the page summary").alias("reason"))),
    )
    return out.select(*row_id, "_r.profile", "_r.meta", "_r.url", error.alias("error"))


def kb_attach(records: DataFrame, profiles: DataFrame, row_id: list[str], name: str = "name", target: str = "kb", lang: str = "", items: str | None = None) -> DataFrame:
    """Attach ``profile``/``miss`` under ``target``; other fields and blank-named records untouched.

    ``items``: a nested record or a list of records in that column instead of the row itself.
    """
    language = lang or DEFAULT_LANG
    right = profiles.where(F.col("lang") == language).select(F.col("query").alias("_q"), F.struct("profile", "miss").alias("_kb"))
    if items is None:
        left = records.withColumn("_q", X.blank_to_null(X.trim_ws(F.col(name))))
        return keyed_join(left, right, "_q").withColumnRenamed("_kb", target).select(*records.columns, target)
    kind = records.schema[items].dataType
    if isinstance(kind, T.StructType):
        left = records.withColumn("_q", X.blank_to_null(X.trim_ws(F.col(items)[name])))
        joined = keyed_join(left, right, "_q")
        return joined.withColumn(items, F.when(F.col(items).isNotNull(), F.col(items).withField(target, F.col("_kb")))).select(*records.columns)
    joined = join_list(records, items, name, row_id, right, "_q")
    new = F.transform(items, lambda x, i: x.withField(target, F.get("_list", i)["_kb"]))
    return joined.withColumn(items, new).select(*records.columns)
