"""Output shaping: item structs → records, page records and page statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions.templates import placeholders, render
from webtables.functions.text import trim_ws

_WHOLE = re.compile(r"^\{([^{}]+)\}$")


def format_value(template, values: dict[str, Column], kinds: dict[str, str]) -> Column:
    """One template node: a whole placeholder keeps its type, mixed text is text, nests recurse."""
    if isinstance(template, dict):
        return F.struct(*[format_value(v, values, kinds).alias(k) for k, v in template.items()])
    if isinstance(template, (list, tuple)):
        return F.array(*[format_value(v, values, kinds) for v in template])
    if isinstance(template, str):
        whole = _WHOLE.match(template)
        if whole and whole.group(1) in values:
            return values[whole.group(1)]
        return render(template, values, kinds)
    return F.lit(template)


def format_record(template: dict, item: Column, schema: T.StructType) -> Column:
    """Output record of one item struct whose type is ``schema``."""
    values = {f.name: item[f.name] for f in schema.fields}
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    return format_value(template, values, kinds)


def shape(extracted: DataFrame, template: dict, items: str = "items") -> DataFrame:
    """Replace each item by its output record; the array stays on its page row, no shuffle."""
    schema = extracted.schema[items].dataType.elementType
    return extracted.withColumn(items, F.transform(F.col(items), lambda i: format_record(template, i, schema)))


def template_names(template) -> list[str]:
    if isinstance(template, dict):
        return [n for v in template.values() for n in template_names(v)]
    if isinstance(template, (list, tuple)):
        return [n for v in template for n in template_names(v)]
    return placeholders(template) if isinstance(template, str) else []


def group_items(extracted: DataFrame, page_format: dict | None = None, items_key: str = "items", page: str = "page") -> DataFrame:
    """Page record ``data``: page fields plus the items under ``items_key`` (which wins a name clash).

    A skipped page layer with a non-empty page format is an output error.
    """
    cols, error = [], F.col("error")
    if page_format:
        schema = extracted.schema[page].dataType if page in extracted.columns else T.StructType([])
        rest = {k: v for k, v in page_format.items() if k != items_key}
        rendered = format_record(rest, F.col(page), schema) if rest else None
        cols = [rendered[k].alias(k) for k in rest] if rest else []
        if template_names(page_format) and page in extracted.columns:
            error = F.coalesce(
                error, F.when(F.col("items").isNotNull() & F.col(page).isNull(), F.lit("missing template variables: " + ", ".join(dict.fromkeys(template_names(page_format)))))
            )
    data = F.struct(*cols, F.col("items").alias(items_key))
    keep = [c for c in extracted.columns if c != "error"]
    with_err = extracted.select(*keep, error.alias("error"))
    return with_err.withColumn("data", F.when(F.col("error").isNull(), data))


def first_or_empty(items: Column) -> Column:
    """First record of an object output; NULL stands for the empty object."""
    return F.get(items, F.lit(0))


def page_counts(extracted: DataFrame, page: Column | None = None, total: Column | None = None) -> DataFrame:
    """Add ``count`` (items kept), ``page_num``/``page_raw`` and ``total``.

    A page value is a number or raw text; two typed columns hold the two cases.
    """
    df = extracted.withColumn("count", F.size("items").cast("bigint"))
    if page is not None:
        num = F.when(trim_ws(page).rlike(r"^[+-]?[0-9]+\z"), trim_ws(page).try_cast("bigint"))
        df = df.withColumn("page_num", num).withColumn("page_raw", F.when(num.isNull(), F.coalesce(page, F.lit(""))))
    if total is not None:
        df = df.withColumn("total", total)
    return df


