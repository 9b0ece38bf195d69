"""Missing-value rules shared by HTML and JSON extraction.

A field compiles to ``struct<v, err>``. A layer (item, page, meta) of fields becomes one struct of
values plus ``err`` and ``skip``; an error anywhere in a page makes the whole page an error row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions.text import let
from webtables.plans.spec import Extract, Field

Reader = Callable[[str, Field], Column]


def missing_value(rule: Field, untyped: str = "string") -> Column:
    """What a missing field becomes: its default, an empty list, or NULL."""
    if rule.multiple:
        kind = "array<bigint>" if rule.is_int and untyped == "variant" else f"array<{_item_type(rule, untyped)}>"
        if rule.default:
            return F.array(F.lit(rule.default)).cast(kind)
        return F.array().cast(kind)
    if rule.default:
        return F.lit(int(rule.default)) if rule.is_int else F.lit(rule.default).cast(_item_type(rule, untyped))
    return F.lit(None).cast("bigint" if rule.is_int else _item_type(rule, untyped))


def _item_type(rule: Field, untyped: str) -> str:
    if untyped == "variant" and not (rule.trim or rule.regex or rule.type.strip()):
        return "variant"
    return "string"


def layer(fields: dict[str, Field], read: Reader, noun: str, untyped: str = "string") -> Column:
    """``struct<value:struct<fields>, err, skip>`` for one layer in one context."""
    names = sorted(fields)
    results = F.struct(*[read(n, fields[n]).alias(n) for n in names])

    def build(r: Column) -> Column:
        errs, skips, values = [], [], []
        for n in names:
            rule, got = fields[n], r[n]
            action = rule.missing_action
            if noun == "meta" and action == "skip_item":
                action = "error"
            missing = got["v"].isNull()
            errs.append(F.concat(F.lit(f'{noun} "{n}": '), got["err"]))
            if action == "error":
                errs.append(F.when(missing & got["err"].isNull(), F.lit(f'{noun} "{n}" is missing')))
            if action == "skip_item":
                skips.append(missing)
        for n in fields:
            values.append(F.coalesce(r[n]["v"], missing_value(fields[n], untyped)).alias(n))
        skip = F.lit(False)
        for s in skips:
            skip = skip | s
        return F.struct(F.struct(*values).alias("value"), F.coalesce(*errs, F.lit(None).cast("string")).alias("err"), skip.alias("skip"))

    return let(results, build)


def assemble(df: DataFrame, spec: Extract, failed: Column) -> DataFrame:
    """Raw layer columns → ``meta``, ``page``, ``items``, ``error``; ``failed`` = unreadable body."""
    keep = [c for c in df.columns if c not in ("_meta", "_page", "_items", "_failed")]
    errs = [failed]
    if spec.meta:
        errs.append(F.col("_meta.err"))
    if spec.page:
        errs.append(F.col("_page.err"))
    if spec.fields:
        errs.append(F.get(F.filter(F.col("_items"), lambda i: i["err"].isNotNull()), F.lit(0))["err"])
    df = df.select("*", F.coalesce(*errs).alias("error"))
    ok = F.col("error").isNull()
    out = [*keep]
    if spec.meta:
        out.append(F.when(ok, F.col("_meta.value")).alias("meta"))
    if spec.page:
        out.append(F.when(ok & ~F.col("_page.skip"), F.col("_page.value")).alias("page"))
    if spec.fields:
        kept = F.transform(F.filter(F.col("_items"), lambda i: ~i["skip"]), lambda i: i["value"])
        out.append(F.when(ok, kept).alias("items"))
    return df.select(*out, "error")
