"""Wikitext queries over whole ``documents`` texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import decoded, derive, query, table
from webtables.catalog.fixtures import WIKITEXT
from webtables.functions import wikitext as K
from webtables.functions.text import explode_rows, let, once
from webtables.sources.pages import spread
from webtables.operators.wikitext import WikiSpec, wiki_text_record, wikitext_tables

W = f"w AS ({WIKITEXT})"
BOX = "n_chars % 2 = 0"
SPEC = WikiSpec(
    infobox="Infobox item",
    text_fields={"name": ["name"], "nick": ["alt", "nick"], "nick2": ["nick2"], "home": ["nohome", "home"]},
    number_fields={"height": ["height"], "width": ["width", "width_alt"]},
    date_fields=("year", "month", "day"),
    composite=("size", ["height", "width"]),
    sections={"resume": ["Histoire", "History"]},
    link_sections=["Links", "Weblinks"],
)


def docs(spark, sf):
    w = derive(spark, sf, WIKITEXT, "doc_id").select("doc_id", "wikitext")
    url = F.transform(
        F.sequence(F.lit(1), F.lit(13)),
        lambda i: F.when(i == 3, F.concat(F.lit("https://web.archive.org/"), F.col("doc_id")))
        .when(i == 5, F.lit("  "))
        .otherwise(F.concat(F.lit(" https://l.example/"), F.col("doc_id"), F.lit("/"), i)),
    )
    return w.select("doc_id", "wikitext", url.alias("external_links"))


def clean_sql(c: str) -> str:
    """The cleaning rules in RE2, for text without templates."""
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
    for pattern, to in (
        (r"(?s)<ref\b[^>/]*?>.*?</ref>", ""), (r"<ref\b[^>]*/>", ""), (r"(?i)<br\s*/?>", "\n"),
        (r"\[\[(?:File|Image|Category):[^\]]+\]\]", ""), (r"\[\[[^|\]]+\|([^\]]+)\]\]", r"\1"), (r"\[\[([^\]]+)\]\]", r"\1"),
        (r"\[(https?://[^\s\]]+)\s+([^\]]+)\]", r"\2"), (r"''{2,}", ""), (r"<[^>]+>", ""),
    ):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    c = decoded(f"replace({c}, '&nbsp;', ' ')")
    for pattern, to in ((r"[ \t\r\f]+", " "), (r"\n{3,}", "\n\n")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"trim({c}, {blanks})"


@query("wiki_clean", f"SELECT doc_id, {clean_sql(chr(39).join(['text || ', ' [[A|b]] <i>x</i> [[File:q|z]] &amp; [http://u.example v w]', '']))} AS plain FROM documents")
def wiki_clean(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id")
    text = F.concat("text", F.lit(" [[A|b]] <i>x</i> [[File:q|z]] &amp; [http://u.example v w]"))
    return d.select("doc_id", K.clean(text).alias("plain"))


@query("wiki_templates", "SELECT doc_id, source || '  ' || '1' || source || ' ' || lang || ' ' || lang || ' / ' || source || ' ' AS plain FROM documents")
def wiki_templates(spark, sf):
    text = F.concat(
        F.lit("{{a|"), "source", F.lit("|x}} {{Wayback|"), "lang", F.lit("}} {{ bd | 1 | "), "source", F.lit("}} {{fact|"), "lang",
        F.lit("|z}} {{jpn|k= '''"), "lang", F.lit("'''|e= |"), "source", F.lit("}} {{none}}"),
    )
    return table(spark, sf, "documents").select("doc_id", let(text, K.simplify_templates).alias("plain"))


@query("wiki_intro", "SELECT doc_id, 'Intro ' || source || ' of ' || n_chars || ' ' || 'bold & c d\nnext 1990 site' AS intro FROM documents")
def wiki_intro(spark, sf):
    more = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Intro "), "source", F.lit(" of [[n|"), F.col("n_chars").cast("string"), F.lit("]] ")).alias("head"))
    d = docs(spark, sf).join(more, "doc_id").withColumn("wikitext", F.replace("wikitext", F.lit("Intro "), F.col("head"))).drop("head")
    return wikitext_tables(d, SPEC)["intro"]


SECTION = "trim(text || '\n\n\n\nend [[File:a.jpg|t]]', ' ' || chr(9) || chr(10) || chr(13))"


@query("wiki_section", f"SELECT doc_id, CASE WHEN lang = 'en' THEN {SECTION} ELSE '' END AS history, 'n' AS notes, '' AS none FROM documents")
def wiki_section(spark, sf):
    return docs(spark, sf).select(
        "doc_id", K.section(F.col("wikitext"), "History").alias("history"), K.section(F.col("wikitext"), "Notes").alias("notes"), K.section(F.col("wikitext"), "His.*").alias("none")
    )


@query("wiki_section_aliases", f"SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN {clean_sql(SECTION)} END AS resume, 'n' AS last_wins FROM documents")
def wiki_section_aliases(spark, sf):
    t = F.col("wikitext")
    return docs(spark, sf).select(
        "doc_id", K.section_aliases(t, ["Histoire", "History"]).alias("resume"), K.section_aliases(t, ["Histoire", "History", "Links", "Notes", "Absent"]).alias("last_wins")
    )


@query("wiki_infobox_body", f"WITH {W} SELECT doc_id, CASE WHEN {BOX} THEN regexp_extract(wikitext, '[{{][{{](Infobox item\n.*?\n)[}}][}}]\nIntro', 1, 's') END AS body FROM w")
def wiki_infobox_body(spark, sf):
    return docs(spark, sf).select("doc_id", K.infobox_body(F.col("wikitext"), "Infobox item").alias("body"))


FIELDS = """(SELECT doc_id, unnest(['name', 'alt', 'nick', 'nick2', 'year', 'month', 'day', 'height', 'width', 'width_alt', 'home']) AS key,
  unnest(['''''''N' || doc_id || '''''''', '', 'first\nsecond {{fact|third|4}}', '[[Page|Label ' || source || ']]', (1900 + doc_id % 100) || '年', CAST(1 + doc_id % 12 AS VARCHAR),
   CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(1 + doc_id % 28 AS VARCHAR) END, 'about ' || (100 + doc_id % 90) || ' cm<ref>r</ref>', '', CAST(doc_id % 50 AS VARCHAR), '{{jpn|a=[[Oslo]]|b= |Rome}}']) AS value FROM documents WHERE n_chars % 2 = 0)"""


@query("wiki_infobox_fields", f"SELECT * FROM {FIELDS}")
def wiki_infobox_fields(spark, sf):
    return wikitext_tables(docs(spark, sf), SPEC)["infobox"]


def fields(spark, sf):
    f = K.infobox_fields(K.infobox_body(F.col("wikitext"), "Infobox item"))
    return docs(spark, sf).select("doc_id", once(f).alias("f")).where(F.col("f").isNotNull())


@query("wiki_alias_profile", f"SELECT doc_id, 'N' || doc_id AS name, 'first\nsecond third' AS nick, 'Label ' || source AS nick2, 'Oslo / Rome' AS home, CAST(NULL AS VARCHAR) AS none FROM documents WHERE {BOX}")
def wiki_alias_profile(spark, sf):
    f = F.col("f")
    return fields(spark, sf).select(
        "doc_id", K.alias_value(f, ["name"]).alias("name"), K.alias_value(f, ["alt", "nick", "nick2"]).alias("nick"), K.alias_value(f, ["nick2", "nick"]).alias("nick2"),
        K.alias_value(f, ["home"]).alias("home"), K.alias_value(f, ["alt", "width", "zzz"]).alias("none"),
    )


@query("wiki_number", f"SELECT doc_id, CAST(100 + doc_id % 90 AS VARCHAR) AS height, CAST(doc_id % 50 AS VARCHAR) AS width, (100 + doc_id % 90) || ' - ' || (doc_id % 50) || ' -  cm' AS size FROM documents WHERE {BOX}")
def wiki_number(spark, sf):
    f = F.col("f")
    height, width, none = K.number_of(f, ["height"]), K.number_of(f, ["width", "width_alt"]), K.number_of(f, ["alt"])
    return fields(spark, sf).select("doc_id", height.alias("height"), width.alias("width"), K.composite([height, width, none]).alias("size"))


@query("wiki_date_parts", f"SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (1900 + doc_id % 100) || '-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') END AS birth_date FROM documents WHERE {BOX}")
def wiki_date_parts(spark, sf):
    f = F.col("f")
    return fields(spark, sf).select("doc_id", K.date_from_parts(*[K.number(K.field_of(f, n)) for n in ("year", "month", "day")]).alias("birth_date"))


OWN_LINKS = """SELECT doc_id, 0 AS pos, 'Twitter' AS label, 'https://twitter.com/joe' || doc_id AS url, 'joe' || doc_id AS username FROM documents WHERE n_chars % 3 <> 0
  UNION ALL SELECT doc_id, 1, 'Label x', 'https://a.example/' || doc_id, NULL FROM documents WHERE n_chars % 3 <> 0
  UNION ALL SELECT doc_id, 2, 'http://b.example', 'http://b.example', NULL FROM documents WHERE n_chars % 3 <> 0
  UNION ALL SELECT doc_id, 3, 'Instagram', 'https://www.instagram.com/pic/', 'pic' FROM documents WHERE n_chars % 3 <> 0"""
FALLBACK = """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, 'https://l.example/' || doc_id || '/' || i AS label, 'https://l.example/' || doc_id || '/' || i AS url, CAST(NULL AS VARCHAR) AS username
  FROM documents, range(1, 14) t(i) WHERE i NOT IN (3, 5)"""


@query("wiki_links", f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, label, url, username FROM ({OWN_LINKS})")
def wiki_links(spark, sf):
    flat = explode_rows(docs(spark, sf), ["doc_id"], once(K.section_links(F.col("wikitext"), SPEC.link_sections)), "pos", "l")
    return flat.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "l.*")


@query("wiki_links_fallback", f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, label, url, username FROM ({OWN_LINKS}) UNION ALL SELECT f.doc_id, CAST(pos AS BIGINT), label, url, username FROM ({FALLBACK}) f JOIN documents d ON d.doc_id = f.doc_id WHERE d.n_chars % 3 = 0")
def wiki_links_fallback(spark, sf):
    return wikitext_tables(docs(spark, sf), SPEC)["links"].withColumn("pos", F.col("pos").cast("bigint"))


@query("wiki_text_record", f"""SELECT doc_id, 'Intro bold & c d\nnext 1990 site' AS intro, CASE WHEN {BOX} THEN 'N' || doc_id END AS name, CASE WHEN {BOX} THEN (100 + doc_id % 90) || ' - ' || (doc_id % 50) || ' cm' END AS size,
  CASE WHEN {BOX} AND doc_id % 5 <> 0 THEN (1900 + doc_id % 100) || '-' || lpad(CAST(1 + doc_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR), 2, '0') END AS birth_date,
  CASE WHEN lang IN ('en', 'fr') THEN {clean_sql(SECTION)} END AS resume, CAST(CASE WHEN n_chars % 3 = 0 THEN 11 ELSE 4 END AS BIGINT) AS n_links FROM documents""")
def wiki_text_record_(spark, sf):
    # Half of the corpus arrives with literal backslash-n sequences.
    d = docs(spark, sf).withColumn("wikitext", F.when(F.col("doc_id") % 2 == 0, F.replace("wikitext", F.lit("\n"), F.lit("\\n"))).otherwise(F.col("wikitext")))
    out = wiki_text_record(d, SPEC)
    return out.select(
        "doc_id", "text.intro", F.col("text.profile.name").alias("name"), F.col("text.profile.size").alias("size"), F.col("text.profile.birth_date").alias("birth_date"),
        "text.resume", F.size("text.external_links").cast("bigint").alias("n_links"),
    )
