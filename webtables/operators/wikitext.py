"""Wikitext corpus → intro, section, infobox and link tables. All in-row: no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import wikitext as K
from webtables.functions.text import explode_rows, first_non_blank, let, once


@dataclass(frozen=True)
class WikiSpec:
    """Names a corpus uses: the infobox, field aliases, headings."""

    infobox: str
    text_fields: dict[str, list[str]] = field(default_factory=dict)
    number_fields: dict[str, list[str]] = field(default_factory=dict)
    date_fields: tuple[str, str, str] | None = None  # year, month, day
    composite: tuple[str, list[str]] | None = None  # output name, number fields
    sections: dict[str, list[str]] = field(default_factory=dict)
    link_sections: list[str] = field(default_factory=list)


def _profile_raws(fields: Column, spec: WikiSpec) -> dict[tuple, Column]:
    """Every raw infobox text the profile needs, by what it is for."""
    raws = {("alias", a): K.field_of(fields, a) for names in spec.text_fields.values() for a in names}
    raws |= {("part", n): K.field_of(fields, n) for n in spec.date_fields or ()}
    raws |= {("number", k): first_non_blank(*[K.field_of(fields, a) for a in names]) for k, names in spec.number_fields.items()}
    return raws


def _profile(cleaned: dict[tuple, Column], spec: WikiSpec) -> Column:
    """Infobox profile from cleaned texts; NULL members are absent parts."""
    out = [
        F.coalesce(*[F.nullif(cleaned["alias", a], F.lit("")) for a in names]).alias(k) for k, names in spec.text_fields.items()
    ]
    if spec.date_fields:
        out.append(K.date_from_parts(*[K.first_digits(cleaned["part", n]) for n in spec.date_fields]).alias("birth_date"))
    numbers = {k: K.first_digits(cleaned["number", k]) for k in spec.number_fields}
    out += [c.alias(k) for k, c in numbers.items()]
    if spec.composite:
        name, parts = spec.composite
        out.append(K.composite([numbers[p] for p in parts]).alias(name))
    return F.struct(*out)


def text_record(wikitext: Column, external_links: Column, spec: WikiSpec) -> Column:
    """intro, profile, sections and links of one page; NULL for a blank page, NULL parts are absent.

    All texts to clean go through one array, so the cleaning chain is in the plan once.
    """

    def build(t: Column) -> Column:
        fields = let(K.infobox_body(t, spec.infobox), lambda b: F.when(b.isNotNull(), K.infobox_fields(b)))
        found = F.struct(
            K.raw_intro(t).alias("intro"),
            fields.alias("fields"),
            F.array(*[K.raw_section(t, titles) for titles in spec.sections.values()], F.lit("")).alias("sections"),
            K.raw_links(t, spec.link_sections).alias("links"),
        )
        return F.when(t.isNotNull(), let(found, finish))

    def finish(r: Column) -> Column:
        raws = _profile_raws(r["fields"], spec)
        fixed = F.array(r["intro"], *raws.values(), *[F.get(r["sections"], F.lit(i)) for i in range(len(spec.sections))])
        every = F.concat(fixed, F.transform(r["links"], lambda l: l["label"]))
        return let(F.transform(every, lambda s: K.clean(s)), lambda c: record(r, c, list(raws)))

    def record(r: Column, c: Column, keys: list) -> Column:
        def at(i):
            return F.nullif(F.get(c, F.lit(i)), F.lit(""))

        cleaned = {k: F.get(c, F.lit(1 + i)) for i, k in enumerate(keys)}
        profile = F.when(r["fields"].isNotNull(), _profile(cleaned, spec))
        first = 1 + len(keys)
        sections = [
            F.when(F.get(r["sections"], F.lit(i)) != "", F.get(c, F.lit(first + i))).alias(k) for i, k in enumerate(spec.sections)
        ]
        own = K.label_links(r["links"], F.slice(c, F.lit(first + len(spec.sections) + 1), F.size(r["links"])))
        links = F.when(F.size(r["links"]) > 0, own).otherwise(K.fallback_links(external_links))
        return F.struct(
            at(0).alias("intro"), profile.alias("profile"), *sections,
            let(links, lambda l: F.when(F.size(l) > 0, l)).alias("external_links"),
        )

    return let(K.newlines(wikitext), build)


def wiki_text_record(docs: DataFrame, spec: WikiSpec, wikitext: str = "wikitext", links: str = "external_links") -> DataFrame:
    keep = [c for c in docs.columns if c not in (wikitext, links)]
    return docs.select(*keep, once(text_record(F.col(wikitext), F.col(links), spec)).alias("text"))


def wikitext_tables(docs: DataFrame, spec: WikiSpec, doc_id: str = "doc_id") -> dict[str, DataFrame]:
    """Four tables keyed by document: ``intro``, ``sections``, ``infobox`` (key/value rows), ``links``."""
    t = docs.select(doc_id, once(K.newlines(F.col("wikitext"))).alias("t"), "external_links").where(F.col("t").isNotNull())
    sections = F.array(*[F.struct(F.lit(k).alias("section"), K.section_aliases(F.col("t"), v).alias("text")) for k, v in spec.sections.items()])
    own = K.section_links(F.col("t"), spec.link_sections)
    links = let(own, lambda l: F.when(F.size(l) > 0, l).otherwise(K.fallback_links(F.col("external_links"))))
    return {
        "intro": t.select(doc_id, once(K.intro(F.col("t"))).alias("intro")).where(F.col("intro") != ""),
        "sections": explode_rows(t, [doc_id], once(F.filter(sections, lambda s: s["text"].isNotNull()))).select(doc_id, "item.*"),
        "infobox": explode_rows(t, [doc_id], once(K.infobox_fields(K.infobox_body(F.col("t"), spec.infobox)))).select(doc_id, "item.*"),
        "links": explode_rows(t, [doc_id], once(links)).select(doc_id, "pos", "item.*"),
    }
