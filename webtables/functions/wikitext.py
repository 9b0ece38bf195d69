"""Wikitext as native columns: balanced templates, cleaning, sections, infobox fields, links."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions import text as X
from webtables.functions.entities import unescape
from webtables.functions.text import let

# Template names with their own rendering, and the kinds that are dropped.
JOINED_TEMPLATE = "bd"
FIRST_ARG_TEMPLATES = ("fact", "link-ja")
LIST_TEMPLATE = "jpn"
DROPPED_TEMPLATES = r"\{\{(?:Wayback|Commonscat|DEFAULTSORT)[^{}]*\}\}"
FLAG_TEMPLATE, FLAG_TEXT = r"\{\{\s*JPN\s*\}\}", "日本"
SOCIAL_TEMPLATE = r"\{\{\s*(Twitter|X|Instagram)\s*\|\s*([^|}]+)"
ARCHIVE_HOST = "web.archive.org"
# What cleaning rewrites, in order, as pattern and replacement; first references and line breaks,
REWRITTEN_REFS = (
    (r"(?s)<ref\b[^>/]*?>.*?</ref>", ""),
    (r"<ref\b[^>]*/>", ""),
    (r"(?i)<br\s*/?>", "\n"),
)
# then, after the templates, flags, links, quotes and tags, and at the end blanks.
REWRITTEN_LINKS = (
    (FLAG_TEMPLATE, FLAG_TEXT),
    (r"\[\[(?:File|Image|Category):[^\]]+\]\]", ""),
    (r"\[\[[^|\]]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\[(https?://[^\s\]]+)\s+([^\]]+)\]", "$2"),
    (r"'{2,}", ""),
    (r"<[^>]+>", ""),
)
REWRITTEN_BLANKS = ((r"[ \t\r\f]+", " "), (r"\n{3,}", "\n\n"))
# Templates without a rendering of their own, reduced to their first argument or dropped.
OTHER_TEMPLATES = ((DROPPED_TEMPLATES, ""), (r"\{\{[^{}|]+\|([^{}|]+)[^{}]*\}\}", "$1"), (r"\{\{[^{}]*\}\}", ""))
# A heading around its title, any heading, and an external link with its label.
HEADING = (r"(?md)^==+[\t\n\f\r ]*\Q", r"\E[\t\n\f\r ]*==+[\t\n\f\r ]*$")
ANY_HEADING = r"(?md)^==+[^=\n].*?==+[\t\n\f\r ]*$"
LABELLED_LINK = r"\[(https?://[^\s\]]+)(?:\s+([^\]]+))?\]"

_BRACES = r"\{\{|\}\}"
LINK = "struct<label:string,url:string,username:string>"


def replace_with(c: Column, java: str, render) -> Column:
    """Replace each match by ``render(match)``: text pieces and matches zipped back together."""
    pieces = F.split(c, java, -1)
    found = F.regexp_extract_all(c, F.lit(java), F.lit(0))
    return F.array_join(
        F.zip_with(pieces, found, lambda p, m: F.concat(p, F.when(m.isNotNull(), render(m)).otherwise(""))), ""
    )


def _template_args(token: Column, name: str) -> Column:
    inner = F.regexp_extract(token, X.compile_regex(r"\{\{\s*" + re.escape(name) + r"\s*\|([^{}]*)\}\}")[0], 1)
    return F.transform(F.split(inner, r"\|", -1), X.trim_ws)


def _replace_template(c: Column, name: str, render) -> Column:
    java = X.compile_regex(r"\{\{\s*" + re.escape(name) + r"\s*\|([^{}]*)\}\}")[0]
    return F.when(c.rlike(java), replace_with(c, java, lambda m: render(_template_args(m, name)))).otherwise(c)


def _rewrite(v: Column, rules) -> Column:
    for pattern, replacement in rules:
        v = X.replace_all(v, pattern, replacement)
    return v


def _rewrite_links_and_tags(v: Column) -> Column:
    """Everything after the template step."""
    v = _rewrite(v, REWRITTEN_LINKS)
    v = let(F.replace(v, F.lit("&nbsp;"), F.lit(" ")), lambda t: unescape(t))
    return X.trim_ws(_rewrite(v, REWRITTEN_BLANKS))


def _rewrite_refs(v: Column) -> Column:
    return _rewrite(X.trim_ws(v), REWRITTEN_REFS)


def simplify_templates(v: Column) -> Column:
    """Known templates rendered, dropped kinds removed, any other reduced to its first argument."""

    def known(t: Column) -> Column:
        t = let(t, lambda s: _replace_template(s, JOINED_TEMPLATE, lambda a: F.array_join(a, "")))
        for name in FIRST_ARG_TEMPLATES:
            t = let(t, lambda s: _replace_template(s, name, lambda a: F.get(a, F.lit(0))))
        t = let(t, lambda s: _replace_template(s, LIST_TEMPLATE, _render_list))
        return _rewrite(t, OTHER_TEMPLATES)

    return F.when(F.contains(v, F.lit("{{")), known(v)).otherwise(v)


def _render_list(args: Column) -> Column:
    """name=value arguments: values cleaned, blanks dropped, joined by ' / '. Arguments hold no braces."""

    def value(a: Column) -> Column:
        raw = F.when(F.contains(a, F.lit("=")), F.substr(a, F.instr(a, "=") + 1)).otherwise(a)
        return let(_rewrite_refs(raw), _rewrite_links_and_tags)

    return F.array_join(F.filter(F.transform(args, value), lambda s: s != ""), " / ")


def clean(v: Column) -> Column:
    """Wikitext → plain text; each rule applied once, in order."""
    return let(let(_rewrite_refs(v), simplify_templates), _rewrite_links_and_tags)


# -- balanced templates -------------------------------------------------------------------------
def _close_index(tokens: Column, start: Column) -> Column:
    """Index of the brace token that closes the template opened by token ``start``; -1 if none."""
    state = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("depth"), F.lit(-1).alias("at"))

    def step(s, tok):
        k = s["k"] + 1
        depth = F.when(k < start, F.lit(0)).when(tok == "{{", s["depth"] + 1).otherwise(s["depth"] - 1)
        at = F.when(s["at"] >= 0, s["at"]).when((k >= start) & (tok == "}}") & (depth == 0), k).otherwise(F.lit(-1))
        return F.struct(k.alias("k"), depth.alias("depth"), at.alias("at"))

    return F.aggregate(tokens, state, step, lambda s: s["at"])


def _rejoin(pieces: Column, tokens: Column, after: Column) -> Column:
    """Text that follows token ``after``."""
    rest_p = F.slice(pieces, after + 2, F.size(pieces))
    rest_t = F.slice(tokens, after + 2, F.size(tokens))
    return F.array_join(F.zip_with(rest_p, rest_t, lambda p, t: F.concat(p, F.coalesce(t, F.lit("")))), "")


def balanced_body(suffix: Column) -> Column:
    """Body of the template that starts ``suffix`` ('{{' first); NULL when it never closes."""
    tokens = F.regexp_extract_all(suffix, F.lit(_BRACES), F.lit(0))
    pieces = F.split(suffix, _BRACES, -1)

    def body(parts: Column) -> Column:
        at = _close_index(parts["t"], F.lit(0))
        return let(
            at,
            lambda k: F.when(
                k >= 0,
                F.array_join(
                    F.zip_with(
                        F.slice(parts["p"], F.lit(2), k),
                        F.slice(parts["t"], F.lit(2), F.greatest(k - 1, F.lit(0))),
                        lambda p, t: F.concat(p, F.coalesce(t, F.lit(""))),
                    ),
                    "",
                ),
            ),
        )

    return let(F.struct(tokens.alias("t"), pieces.alias("p")), body)


def strip_leading_templates(text: Column) -> Column:
    """Text after its leading balanced templates; the text as given if one of them never closes."""
    start = X.trim_ws(text)
    tokens = F.regexp_extract_all(start, F.lit(_BRACES), F.lit(0))
    pieces = F.split(start, _BRACES, -1)
    state = F.struct(F.lit(-1).alias("k"), F.lit(0).alias("depth"), F.lit(-1).alias("cut"), F.lit(False).alias("stop"))

    def run(parts: Column) -> Column:
        def step(s, tok):
            k = s["k"] + 1
            gap = F.get(parts["p"], k)  # text before this token
            # A new leading template must follow the last one directly.
            ends = (s["depth"] == 0) & ((tok == "}}") | (X.trim_ws(gap) != ""))
            stop = s["stop"] | ends
            depth = F.when(stop, s["depth"]).when(tok == "{{", s["depth"] + 1).otherwise(s["depth"] - 1)
            cut = F.when(~stop & (depth == 0), k).otherwise(s["cut"])
            return F.struct(k.alias("k"), depth.alias("depth"), cut.alias("cut"), stop.alias("stop"))

        done = F.aggregate(parts["t"], state, step)
        return let(
            done,
            lambda d: F.when(d["depth"] != 0, text).otherwise(X.trim_ws(_rejoin(parts["p"], parts["t"], d["cut"]))),
        )

    return F.when(
        start.startswith("{{"), let(F.struct(tokens.alias("t"), pieces.alias("p")), run)
    ).otherwise(start)


def raw_intro(text: Column) -> Column:
    return let(strip_leading_templates(text), lambda r: F.substring_index(X.trim_ws(r), "\n==", 1))


def intro(text: Column) -> Column:
    """Cleaned text before the first heading, without leading templates."""
    return let(raw_intro(text), clean)


def infobox_body(text: Column, name: str) -> Column:
    """Body of the first balanced template with exactly this name; NULL if there is none."""
    marker = "{{" + name
    java = r"\Q" + marker + r"\E(?=[\n|} ]|\z)"
    pieces = F.split(text, java, -1)

    def find(p: Column) -> Column:
        candidates = F.sequence(F.lit(2), F.size(p))
        tries = F.aggregate(
            candidates,
            F.lit(None).cast("string"),
            lambda got, i: F.when(got.isNotNull(), got).otherwise(
                balanced_body(F.concat(F.lit(marker), F.array_join(F.slice(p, i, F.size(p)), marker)))
            ),
        )
        return F.when(F.size(p) > 1, tries)

    return F.when(F.contains(text, F.lit(marker)), let(pieces, find))


def infobox_fields(body: Column) -> Column:
    """``array<struct<key,value>>`` in order of last definition; a later key overrides an earlier one."""
    # Lines that start with '|' but hold no '=' are ignored; text after them continues the field before.
    kept = F.regexp_replace(body, r"(?U)(^|\n)[^\S\n]*\|[^=\n]*(?=\n|\z)", "")
    chunks = F.split(kept, r"(?U)(?:^|\n)[^\S\n]*\|", -1)

    def entry(c: Column) -> Column:
        lines = F.transform(F.split(F.substr(c, F.instr(c, "=") + 1), "\n"), X.trim_ws)
        return F.struct(
            X.trim_ws(F.substring_index(c, "=", 1)).alias("key"),
            F.array_join(F.filter(lines, lambda s: s != ""), "\n").alias("value"),
        )

    def last_wins(e: Column) -> Column:
        keys = F.reverse(F.transform(e, lambda x: x["key"]))
        return F.filter(e, lambda x, i: F.array_position(keys, x["key"]) == F.size(e) - i)

    return let(F.transform(F.slice(chunks, F.lit(2), F.size(chunks)), entry), last_wins)


def field_of(fields: Column, key: str) -> Column:
    """Raw value of an infobox key; empty when absent."""
    return F.coalesce(F.get(F.filter(fields, lambda e: e["key"] == key), F.lit(0))["value"], F.lit(""))


def alias_value(fields: Column, aliases: list[str]) -> Column:
    """Cleaned value of the first alias that is not empty; NULL if all are."""
    cleaned = F.transform(F.array(*[field_of(fields, a) for a in aliases]), lambda s: clean(s))
    return F.get(F.filter(cleaned, lambda v: v != ""), F.lit(0))


def first_digits(cleaned: Column) -> Column:
    return F.nullif(F.regexp_extract(cleaned, r"(\d+)", 1), F.lit(""))


def number(raw: Column) -> Column:
    """First digit run of the cleaned value; NULL if none."""
    return first_digits(clean(raw))


def number_of(fields: Column, aliases: list[str]) -> Column:
    """Number of the first alias whose raw value is not blank."""
    return number(X.first_non_blank(*[field_of(fields, a) for a in aliases]))


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """year-month-day, month and day padded to two digits and never cut; NULL if a part is missing."""

    def pad(c: Column) -> Column:
        return F.when(F.length(c) >= 2, c).otherwise(F.lpad(c, 2, "0"))

    return F.concat(year, F.lit("-"), pad(month), F.lit("-"), pad(day))


def composite(parts: list[Column], unit: str = "cm") -> Column:
    """'a - b - c unit' when any part is present; missing parts stay empty."""
    shown = F.array_join(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), " - ")
    return F.when(F.coalesce(*parts).isNotNull(), X.trim_ws(F.concat(shown, F.lit(f" {unit}"))))


# -- sections and links -------------------------------------------------------------------------
def section(text: Column, title: str) -> Column:
    """Trimmed text between a heading (any level) and the next heading; empty when absent."""
    head = HEADING[0] + title + HEADING[1]
    after = F.get(F.split(text, head, 2), F.lit(1))
    return F.coalesce(X.trim_ws(F.get(F.split(after, ANY_HEADING, 2), F.lit(0))), F.lit(""))


def raw_section(text: Column, titles: list[str]) -> Column:
    """Section under several spellings; the last one present wins. Empty if none is."""
    return F.coalesce(*[F.nullif(section(text, t), F.lit("")) for t in reversed(titles)], F.lit(""))


def section_aliases(text: Column, titles: list[str]) -> Column:
    """The same, cleaned; NULL if no spelling is present."""
    return let(raw_section(text, titles), lambda s: F.when(s != "", clean(s)))


def _social(line: Column) -> Column:
    java = X.compile_regex(SOCIAL_TEMPLATE)[0]
    kind, user = F.lower(F.regexp_extract(line, java, 1)), X.trim_ws(F.regexp_extract(line, java, 2))
    twitter = F.struct(F.lit("Twitter").alias("label"), F.concat(F.lit("https://twitter.com/"), user).alias("url"), user.alias("username"))
    instagram = F.struct(
        F.lit("Instagram").alias("label"), F.concat(F.lit("https://www.instagram.com/"), user, F.lit("/")).alias("url"), user.alias("username")
    )
    return F.when(line.rlike(java), F.array(F.when(kind == "instagram", instagram).otherwise(twitter)))


def _bracket_links(line: Column) -> Column:
    """Links with their labels as written."""
    java = X.compile_regex(LABELLED_LINK)[0]
    return F.transform(
        F.regexp_extract_all(line, F.lit(java), F.lit(0)),
        lambda tok: F.struct(
            F.regexp_extract(tok, java, 2).alias("label"), F.regexp_extract(tok, java, 1).alias("url"), F.lit(None).cast("string").alias("username")
        ),
    )


def raw_links(text: Column, titles: list[str]) -> Column:
    """Links of the first non-empty section among ``titles``, in line order, labels not yet cleaned."""
    found = F.coalesce(*[let(section(text, t), lambda s: F.when(s != "", s)) for t in titles]) if titles else F.lit(None).cast("string")
    lines = F.transform(
        F.split(found, "\n"), lambda s: X.trim_ws(F.regexp_replace(X.trim_ws(s), r"^\*", ""))
    )
    per_line = F.transform(F.filter(lines, lambda s: s != ""), lambda s: F.coalesce(_social(s), _bracket_links(s)))
    return F.coalesce(F.flatten(per_line), F.array().cast(f"array<{LINK}>"))


def label_links(links: Column, labels: Column) -> Column:
    """``links`` with cleaned ``labels``; an empty label is the URL, social labels are fixed."""

    def relabel(link: Column, label: Column) -> Column:
        shown = F.when(link["username"].isNotNull(), link["label"]).when(label != "", label).otherwise(link["url"])
        return F.struct(shown.alias("label"), link["url"].alias("url"), link["username"].alias("username"))

    return F.zip_with(links, labels, relabel)


def section_links(text: Column, titles: list[str]) -> Column:
    """Links of the first non-empty section among ``titles``, in line order."""
    return let(raw_links(text, titles), lambda l: label_links(l, F.transform(l, lambda x: clean(x["label"]))))


def fallback_links(urls: Column) -> Column:
    """Listed URLs without blanks and archive copies, all of them."""
    kept = F.filter(F.transform(urls, X.trim_ws), lambda u: (u != "") & ~F.contains(u, F.lit(ARCHIVE_HOST)))
    links = F.transform(
        kept,
        lambda u: F.struct(u.alias("label"), u.alias("url"), F.lit(None).cast("string").alias("username")),
    )
    return F.coalesce(links, F.array().cast(f"array<{LINK}>"))


def newlines(text: Column) -> Column:
    """Trimmed wikitext with literal backslash-n sequences turned into newlines; NULL when blank."""
    return let(X.trim_ws(text), lambda t: F.when(t != "", F.replace(t, F.lit("\\n"), F.lit("\n"))))
