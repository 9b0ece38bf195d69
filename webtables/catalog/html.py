"""HTML extraction queries (DOM, fields, selectors) over the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import LINKS, absolute, decoded, query, table
from webtables.functions import select as S
from webtables.operators import html as H
from webtables.plans.spec import Extract, Field
from webtables.sources.pages import spread

LI_A = S.descendant("li").child("a")


def pages(spark, sf):
    return spread(table(spark, sf, "pages"), "page_id")


def items(spark, sf, fields, scope=S.descendant("li")):
    return H.extract_items(pages(spark, sf), Extract(fields=fields, scope=scope), keep=["page_id"])


def page_values(spark, sf, fields):
    """Page-layer fields as top-level columns."""
    out = H.extract_html(pages(spark, sf), Extract(page=fields), keep=["page_id"])
    return out.select("page_id", "page.*")


ONE = "CAST(len(regexp_extract_all(html, '{0}')) AS BIGINT) AS {1}"


@query(
    "parse_dom",
    "SELECT page_id, " + ", ".join(ONE.format(r, n) for r, n in [
        ("<li>", "li"), ("<a ", "a"), ("<h1>", "h1"), ("<div ", "div"), ("<meta ", "meta"), ("<title>", "title"),
        ("<script>", "script"), ("<footer>", "footer"), ("<br>", "br"),
    ]) + ", CAST(1 AS BIGINT) AS html, CAST(1 AS BIGINT) AS body FROM pages",
)
def parse_dom(spark, sf):
    tags = ["li", "a", "h1", "div", "meta", "title", "script", "footer", "br", "html", "body"]
    dom = H.with_dom(pages(spark, sf), with_html=False)
    return dom.select(
        "page_id",
        *[F.size(F.filter(F.col("dom.nodes"), lambda n: n["tag"] == t)).cast("bigint").alias(t) for t in tags],
    )


@query(
    "dom_nodes",
    """WITH t AS (
      SELECT 'li' AS tag, len(regexp_extract_all(html, '<li>')) AS n, page_id FROM pages
      UNION ALL SELECT 'a', len(regexp_extract_all(html, '<a ')), page_id FROM pages
      UNION ALL SELECT 'p', len(regexp_extract_all(html, '<p>')), page_id FROM pages
      UNION ALL SELECT 'ul', len(regexp_extract_all(html, '<ul>')), page_id FROM pages
      UNION ALL SELECT 'title', len(regexp_extract_all(html, '<title>')), page_id FROM pages
      UNION ALL SELECT 'footer', len(regexp_extract_all(html, '<footer>')), page_id FROM pages)
    SELECT tag, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) FILTER (n > 0) AS BIGINT) AS n_pages FROM t GROUP BY tag""",
)
def dom_nodes(spark, sf):
    dom = H.with_dom(pages(spark, sf).select("page_id", "html"), with_html=False).drop("html")
    return (
        H.dom_nodes(dom)
        .where(F.col("tag").isin("li", "a", "p", "ul", "title", "footer"))
        .groupBy("tag")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page_id").alias("n_pages"))
    )


@query("scope_items", f"WITH {LINKS} SELECT page_id, pos, txt AS label FROM links")
def scope_items(spark, sf):
    return items(spark, sf, {"label": Field(S.self_node())}).select("page_id", F.col("pos").cast("bigint").alias("pos"), "label")


@query("field_text", f"SELECT page_id, {decoded(decoded(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)</title>', ', 1)'])))} AS title FROM pages")
def field_text(spark, sf):
    return page_values(spark, sf, {"title": Field(S.descendant("title"))})


@query("field_html", "SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1, 's') AS nav FROM pages")
def field_html(spark, sf):
    return page_values(spark, sf, {"nav": Field(S.descendant("nav"), attr="html")})


@query("field_outer_html", "SELECT page_id, regexp_extract(html, '<ul>.*?</ul>', 0, 's') AS ul FROM pages")
def field_outer_html(spark, sf):
    return page_values(spark, sf, {"ul": Field(S.descendant("ul"), attr="outer_html")})


@query("field_attr", "SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, CAST(NULL AS VARCHAR) AS dir FROM pages")
def field_attr(spark, sf):
    return page_values(spark, sf, {"lang": Field(S.descendant("html"), attr="lang"), "dir": Field(S.descendant("html"), attr="dir")})


FOOTER = decoded(decoded("regexp_extract(html, '<footer>(.*?)</footer>', 1, 's')"))
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


@query("field_trim", f"SELECT page_id, trim({FOOTER}, {WS}) AS footer FROM pages")
def field_trim(spark, sf):
    return page_values(spark, sf, {"footer": Field(S.descendant("footer"), trim=True)})


# RE2 patterns with folds, quotes, scoped flags and nested brackets; the SQL side runs them as they are.
RE2 = {
    "accent": (r"(?i)[[:alpha:]]*É[[:alpha:]É]*", 0),
    "quoted": (r"\Q%%%\E\s+(?P<next_word>\pL+)", 1),
    "scoped": (r"(?i:DE|THE)[^&&[:space:]%]*\s((?-i:[a-z&&])\w*)", 1),
    "border": (r"\b[A-Z](?U:\w+)\b", 0),
    "classes": (r"[^[:^alpha:]\x{61}-m]{2,}", 0),
}
RE2_SQL = ", ".join(f"nullif(regexp_extract({decoded(decoded(chr(39).join(['regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)'])))}, '{p}', {g}), '') AS {n}" for n, (p, g) in RE2.items())


@query("field_regex", f"SELECT page_id, nullif(regexp_extract({FOOTER}, '© ([^ ]+) ·', 1), '') AS host, nullif(regexp_extract({FOOTER}, '[0-9]+', 0), '') AS digits, {RE2_SQL} FROM pages")
def field_regex(spark, sf):
    return page_values(
        spark, sf,
        {
            "host": Field(S.descendant("footer"), regex=r"© ([^ ]+) ·"), "digits": Field(S.descendant("footer"), regex=r"[0-9]+"),
            **{n: Field(S.descendant("h1"), regex=p, group=g) for n, (p, g) in RE2.items()},
        },
    )


@query("field_regex_all", f"""WITH {LINKS}, w AS (SELECT page_id, pos, unnest(regexp_extract_all(txt, '[a-z]+')) AS w, generate_subscripts(regexp_extract_all(txt, '[a-z]+'), 1) AS k FROM links),
  g AS (SELECT page_id, string_agg(w, '|' ORDER BY pos, k) AS words, count(*) AS n FROM w GROUP BY page_id)
  SELECT p.page_id, coalesce(words, '') AS words, CAST(coalesce(n, 0) AS BIGINT) AS n FROM pages p LEFT JOIN g USING (page_id)""")
def field_regex_all(spark, sf):
    out = page_values(spark, sf, {"w": Field(LI_A, regex=r"[a-z]+", multiple=True)})
    return out.select("page_id", F.array_join("w", "|").alias("words"), F.size("w").cast("bigint").alias("n"))


@query("field_unescape", f"SELECT page_id, {decoded(decoded(chr(39).join(['regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)'])))} AS h1, {decoded(decoded(decoded(chr(39).join(['regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)']))))} AS again FROM pages")
def field_unescape(spark, sf):
    from webtables.functions.entities import unescape

    out = page_values(spark, sf, {"h1": Field(S.descendant("h1"))})
    return out.withColumn("again", unescape(F.col("h1")))


@query("resolve_url", f"WITH {LINKS} SELECT page_id, pos, href, {absolute('url', 'href')} AS abs_url FROM links")
def resolve_url(spark, sf):
    got = items(spark, sf, {"href": Field(S.child("a"), attr="href"), "abs_url": Field(S.child("a"), attr="href", resolve_url=True)})
    return got.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "abs_url")


@query("field_to_int", """SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]+)(?:[/?#.]|$)', 1), '') AS BIGINT) AS num,
  CASE WHEN regexp_matches(html, '<script>.*track\\(([0-9]+)\\)') THEN CAST(regexp_extract(html, 'track\\(([0-9]+)\\)', 1) AS BIGINT) END AS track FROM pages""")
def field_to_int(spark, sf):
    with_url = pages(spark, sf).withColumn("html", F.concat(F.lit("<base href='"), F.col("url"), F.lit("'>"), F.col("html")))
    out = H.extract_html(
        with_url,
        Extract(
            page={
                "num": Field(S.descendant("base"), attr="href", regex=r"/([0-9]+)(?:[/?#.]|$)", type="int"),
                "track": Field(S.descendant("script"), regex=r"track\(([0-9]+)\)", type="int"),
            },
        ),
        keep=["page_id"],
    )
    return out.select("page_id", "page.*")


@query("field_single", f"WITH {LINKS} SELECT p.page_id, l.txt AS first_link FROM pages p LEFT JOIN links l ON l.page_id = p.page_id AND l.pos = 0")
def field_single(spark, sf):
    return page_values(spark, sf, {"first_link": Field(LI_A)})


@query("field_multiple", f"WITH {LINKS} SELECT p.page_id, coalesce(string_agg(l.href, ' ' ORDER BY pos), '') AS hrefs, CAST(count(l.href) AS BIGINT) AS n FROM pages p LEFT JOIN links l USING (page_id) GROUP BY p.page_id")
def field_multiple(spark, sf):
    out = page_values(spark, sf, {"h": Field(LI_A, attr="href", multiple=True)})
    return out.select("page_id", F.array_join("h", " ").alias("hrefs"), F.size("h").cast("bigint").alias("n"))


COMMA = "nullif(regexp_extract(txt, '[^,]+,', 0), '')"


@query("on_missing_null", f"WITH {LINKS} SELECT page_id, pos, {COMMA} AS none, coalesce({COMMA}, 'n/a') AS dflt, coalesce({COMMA}, '') AS lst FROM links")
def on_missing_null(spark, sf):
    got = items(spark, sf, {
        "none": Field(S.child("a"), regex=r"[^,]+,"),
        "dflt": Field(S.child("a"), regex=r"[^,]+,", default="n/a"),
        "lst": Field(S.child("a"), regex=r"[^,]+,", multiple=True),
    })
    return got.select("page_id", F.col("pos").cast("bigint").alias("pos"), "none", "dflt", F.array_join("lst", " ").alias("lst"))


@query("on_missing_skip", f"WITH {LINKS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, {COMMA} AS word FROM links WHERE {COMMA} IS NOT NULL")
def on_missing_skip(spark, sf):
    got = items(spark, sf, {"word": Field(S.child("a"), regex=r"[^,]+,", on_missing="skip_item")})
    return got.select("page_id", F.col("pos").cast("bigint").alias("pos"), "word")


@query("on_missing_error", f"""WITH {LINKS}, g AS (SELECT page_id, bool_or(NOT regexp_matches(txt, '^[A-Za-z]')) AS bad, count(*) AS n FROM links GROUP BY page_id)
  SELECT p.page_id, CASE WHEN bad THEN 'field "word" is missing' END AS error, CASE WHEN NOT coalesce(bad, false) THEN CAST(coalesce(n, 0) AS BIGINT) END AS n FROM pages p LEFT JOIN g USING (page_id)""")
def on_missing_error(spark, sf):
    out = H.extract_html(
        pages(spark, sf),
        Extract(fields={"word": Field(S.child("a"), regex=r"^[A-Za-z]", required=True)}, scope=S.descendant("li")),
        keep=["page_id"],
    )
    return out.select("page_id", "error", F.when(F.col("error").isNull(), F.size("items").cast("bigint")).alias("n"))


@query("page_meta", f"""WITH h AS (SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, {decoded(decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))} AS h1 FROM pages)
  SELECT page_id, CASE WHEN h1 LIKE '%,%' THEN lang END AS lang, CASE WHEN NOT h1 LIKE '%,%' THEN 'meta "comma" is missing' END AS error FROM h""")
def page_meta(spark, sf):
    meta = {"lang": Field(S.descendant("html"), attr="lang"), "comma": Field(S.descendant("h1"), regex=",", on_missing="skip_item")}
    return H.extract_html(pages(spark, sf), Extract(meta=meta), keep=["page_id"]).select("page_id", "meta.lang", "error")


H1 = decoded(decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)"))


@query("page_fields", f"""SELECT page_id, CASE WHEN regexp_matches({H1}, ',') THEN {H1} END AS h1, NOT regexp_matches({H1}, ',') AS skipped FROM pages""")
def page_fields(spark, sf):
    fields = {"h1": Field(S.descendant("h1")), "comma": Field(S.descendant("h1"), regex=",", on_missing="skip_item")}
    out = H.extract_html(pages(spark, sf), Extract(page=fields), keep=["page_id"])
    return out.select("page_id", "page.h1", F.col("page").isNull().alias("skipped"))


# -- selectors ----------------------------------------------------------------------------------
def counted(spark, sf, selectors, source=pages):
    """Per page: number of nodes each selector finds."""
    dom = H.with_dom(source(spark, sf).select("page_id", "html"), with_html=False)
    root = F.get(F.col("dom.nodes"), F.lit(0))
    return dom.select("page_id", *[F.size(s.apply(F.col("dom"), root)).cast("bigint").alias(k) for k, s in selectors.items()])


LI = "CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT)"


@query("sel_descendant", f"SELECT page_id, {LI} AS li, {LI} AS nav_a, CAST(len(regexp_extract_all(html, '<p>')) AS BIGINT) AS article_p FROM pages")
def sel_descendant(spark, sf):
    return counted(spark, sf, {"li": S.descendant("li"), "nav_a": S.descendant("nav").descendant("a"), "article_p": S.descendant("article").descendant("p")})


def marked(spark, sf):
    """Pages behind a part whose shape follows from the page's number, so that SQL can tell axes and texts apart."""
    def times(text, n):
        return F.repeat(F.lit(text), n.cast("int"))

    k = F.col("page_id")
    part = F.concat(
        F.lit("<section>"), times("<p>x</p>", k % 5), F.lit("<div>"), times("<p>y</p>", k % 3), F.lit("</div></section>"),
        times("<span>an<q>x</q></span>", k % 4), times("<span>x<q>an</q></span>", k % 7),
        times("<dl><dt><q>in</q></dt></dl>", k % 3), times("<dl><q>in</q></dl>", k % 2),
    )
    return pages(spark, sf).withColumn("html", F.concat(part, F.col("html")))


@query("sel_child", f"SELECT page_id, {LI} AS ul_li, page_id % 5 AS section_p, page_id % 5 + page_id % 3 AS section_all, page_id % 3 AS div_p, CAST(CASE WHEN page_id % 5 > 2 THEN 1 ELSE 0 END AS BIGINT) AS third FROM pages")
def sel_child(spark, sf):
    return counted(spark, sf, {
        "ul_li": S.descendant("ul").child("li"), "section_p": S.descendant("section").child("p"), "section_all": S.descendant("section").descendant("p"),
        "div_p": S.descendant("section").child("div").child("p"), "third": S.descendant("section").child("p").nth(3),
    }, marked)


@query("sel_self_parent_sibling", f"""WITH {LINKS}, u AS (SELECT page_id, string_agg(txt, '' ORDER BY pos) AS up FROM links GROUP BY page_id),
  c AS (SELECT l.page_id, l.pos, min(n.pos) AS at FROM links l JOIN links n ON n.page_id = l.page_id AND n.pos > l.pos AND n.txt LIKE '%e%' GROUP BY l.page_id, l.pos)
  SELECT l.page_id, l.pos, l.txt AS own, u.up, n.txt AS next_txt, t.txt AS third, e.txt AS next_e FROM links l JOIN u USING (page_id) LEFT JOIN links n ON n.page_id = l.page_id AND n.pos = l.pos + 1
  LEFT JOIN links t ON t.page_id = l.page_id AND t.pos = l.pos + 3 LEFT JOIN c ON c.page_id = l.page_id AND c.pos = l.pos LEFT JOIN links e ON e.page_id = l.page_id AND e.pos = c.at""")
def sel_self_parent_sibling(spark, sf):
    got = items(spark, sf, {
        "own": Field(S.self_node()), "up": Field(S.parent()), "next_txt": Field(S.following_sibling("*").nth(1)),
        "third": Field(S.following_sibling("li").nth(3)), "next_e": Field(S.following_sibling("li", S.text_contains("e"))),
    })
    return got.select("page_id", F.col("pos").cast("bigint").alias("pos"), "own", "up", "next_txt", "third", "next_e")


@query("sel_predicates", f"""WITH {LINKS}, c AS (SELECT page_id, count(*) FILTER (href LIKE '%,%') AS href_comma, count(*) FILTER (href LIKE '/t%') AS href_t,
    count(*) FILTER (txt = 'the') AS is_the, count(*) FILTER (NOT txt LIKE '%an%' AND (txt LIKE '%e%' OR href LIKE '/t%')) AS mixed FROM links GROUP BY page_id)
  SELECT p.page_id, {LI} AS with_href, CAST(coalesce(href_comma, 0) AS BIGINT) AS href_comma, CAST(coalesce(href_t, 0) AS BIGINT) AS href_t,
    page_id % 4 + page_id % 7 AS text_an, page_id % 4 AS direct_an, CAST(coalesce(is_the, 0) AS BIGINT) AS is_the,
    CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) AS ad_class, CAST(len(regexp_extract_all(html, '<div class="ad">')) AS BIGINT) AS ad_attr,
    page_id % 3 + page_id % 2 AS has_q, page_id % 2 AS child_q, CAST(coalesce(mixed, 0) AS BIGINT) AS mixed
  FROM pages p LEFT JOIN c USING (page_id)""")
def sel_predicates(spark, sf):
    return counted(spark, sf, {
        "with_href": S.descendant("a", S.has_attr("href")),
        "href_comma": S.descendant("a", S.attr_contains("href", ",")),
        "href_t": S.descendant("a", S.attr_starts_with("href", "/t")),
        "text_an": S.descendant("span", S.text_contains("an")),
        "direct_an": S.descendant("span", S.direct_text_contains("an")),
        "is_the": S.descendant("a", S.text_is("the")),
        "ad_class": S.descendant("div", S.has_class("ad")),
        "ad_attr": S.descendant("*", S.attr_is("class", "ad")),
        "has_q": S.descendant("dl", S.has_descendant("q")),
        "child_q": S.descendant("dl", S.has_child("q")),
        "mixed": S.descendant("a", S.not_(S.text_contains("an")), S.any_of(S.text_contains("e"), S.attr_starts_with("href", "/t"))),
    }, marked)


@query("sel_position", f"""WITH {LINKS}, n AS (SELECT page_id, max(pos) AS m FROM links GROUP BY page_id)
  SELECT p.page_id, a.txt AS second_li, b.txt AS last_li, c.txt AS first_all, b.txt AS last_all, CAST(NULL AS VARCHAR) AS empty_sel
  FROM pages p LEFT JOIN n USING (page_id) LEFT JOIN links a ON a.page_id = p.page_id AND a.pos = 1
  LEFT JOIN links b ON b.page_id = p.page_id AND b.pos = n.m LEFT JOIN links c ON c.page_id = p.page_id AND c.pos = 0""")
def sel_position(spark, sf):
    return page_values(spark, sf, {
        "second_li": Field(S.descendant("li").nth(2)),
        "last_li": Field(S.descendant("li").nth(-1)),
        "first_all": Field(LI_A.first()),
        "last_all": Field(LI_A.last()),
        "empty_sel": Field(None),
    })
