"""``{name}`` templates compiled to column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLACEHOLDER = re.compile(r"\{([^{}]+)\}")


def placeholders(template: str) -> list[str]:
    """Distinct placeholder names of a plan-time template, first seen first."""
    return list(dict.fromkeys(_PLACEHOLDER.findall(template)))


def placeholders_of(template: Column) -> Column:
    """The same for a column of templates."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(r"\{([^{}]+)\}"), F.lit(1)))


def as_text(c: Column, kind: str | None = None) -> Column:
    """Text of a template value: NULL is empty, lists are joined by commas."""
    if kind and kind.startswith("array"):
        return F.coalesce(F.array_join(c.cast("array<string>"), ","), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def render(template: str, values: dict[str, Column], kinds: dict[str, str] | None = None) -> Column:
    """Template over known columns; an unknown name is a plan-time error listing all of them."""
    unknown = [n for n in placeholders(template) if n not in values]
    if unknown:
        raise ValueError(f"missing template variables: {', '.join(unknown)}")
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        parts.append(as_text(values[m.group(1)], (kinds or {}).get(m.group(1))))
        at = m.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def render_map(template: str, params: Column, missing_as_empty: bool = False) -> Column:
    """Template over a ``map<string,string>`` column; NULL when a key is absent (see ``missing_keys``)."""
    values = {n: F.try_element_at(params, F.lit(n)) for n in placeholders(template)}
    out = render(template, values)
    return out if missing_as_empty else F.when(missing_keys(template, params) == "", out)


def missing_keys(template: str, params: Column) -> Column:
    """Comma list of the template's names that the map does not hold."""
    names = placeholders(template)
    if not names:
        return F.lit("")
    absent = [F.when(~F.map_contains_key(params, F.lit(n)), F.lit(n)) for n in names]
    return F.concat_ws(", ", *absent)
