"""JSON extraction: captured JSON bodies → metadata, page record and item records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import text as X
from webtables.functions.variant import json_node, json_path, json_text, parse_json
from webtables.operators.layers import assemble, layer
from webtables.plans.spec import ALL, Extract, Field


def _clean(rule: Field, value: Column) -> Column:
    """``struct<v, err>`` of one non-null value."""
    none = F.lit(None).cast("string")
    if not (rule.trim or rule.regex or rule.type.strip()):
        return F.struct(value.alias("v"), none.alias("err"))
    t = json_text(value)
    if rule.trim:
        t = X.trim_ws(t)
    err = none
    if rule.regex:
        java, groups = X.compile_regex(rule.regex)
        group = X.pick_group(rule.group, groups)
        if group > groups:
            err = F.when(t.rlike(java), F.lit(f"regex_group {group} out of range for {rule.regex!r}"))
            t = none
        else:
            source = t
            t = X.let(source, lambda s: F.when(s.rlike(java), F.regexp_extract(s, java, group)))
        if rule.trim:
            t = X.trim_ws(t)

    def finish(s: Column) -> Column:
        s = F.when(s != "", s)
        if not rule.is_int:
            return F.struct(s.alias("v"), err.alias("err"))
        n = X.to_int(s)
        bad = F.when(s.isNotNull() & n.isNull(), F.concat(F.lit('convert "'), s, F.lit('" to int')))
        return F.struct(n.alias("v"), F.coalesce(err, bad).alias("err"))

    return X.let(t, finish)


def json_field(rule: Field, root: Column) -> Column:
    """``struct<v, err>`` of a rule: the first node, or every node with ``multiple``."""
    typed = rule.trim or rule.regex or rule.type.strip()
    kind = "bigint" if rule.is_int else "string" if typed else "variant"
    if not rule.path:
        if rule.path is None:
            kind = f"array<{kind}>" if rule.multiple else kind
            return F.struct(F.lit(None).cast(kind).alias("v"), F.lit(None).cast("string").alias("err"))
    nodes = json_path(root, rule.path)
    if not rule.multiple:
        single = not any(s == ALL or isinstance(s, int) and s < 0 for s in rule.path)
        first = json_node(root, rule.path) if single else F.get(nodes, F.lit(0))
        if typed:  # JSON null has no text
            return X.let(first, lambda v: _clean(rule, v))
        return X.let(first, lambda v: X.let(F.when(~F.is_variant_null(v), v), lambda w: _clean(rule, w)))
    cleaned = F.transform(F.filter(nodes, lambda v: ~F.is_variant_null(v)), lambda v: _clean(rule, v))

    def pick(vals: Column) -> Column:
        good = F.transform(F.filter(vals, lambda x: x["v"].isNotNull()), lambda x: x["v"])
        err = F.get(F.filter(vals, lambda x: x["err"].isNotNull()), F.lit(0))["err"]
        return F.struct(F.when(F.size(good) > 0, good).alias("v"), err.alias("err"))

    return X.let(cleaned, pick)


def extract_json(pages: DataFrame, spec: Extract, body: str | Column = "body", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns + ``meta``, ``page``, ``items``, ``error``; all native, no shuffle."""
    keep = [c for c in pages.columns if c != body] if keep is None else keep
    raw = F.col(body) if isinstance(body, str) else body
    parsed = pages.select(*[F.col(c) for c in keep], raw.isNotNull().alias("_has"), X.once(parse_json(raw)).alias("_v"))
    root = F.col("_v")
    scope = json_path(root, spec.scope) if spec.scope else F.array(root)

    def one(fields, context, noun):
        return layer(fields, lambda _, rule: json_field(rule, context), noun, untyped="variant")

    cols = [F.col(c) for c in keep]
    if spec.meta:
        cols.append(X.once(one(spec.meta, root, "meta")).alias("_meta"))
    if spec.page:
        cols.append(X.once(one(spec.page, root, "field")).alias("_page"))
    if spec.fields:
        items = F.when(root.isNotNull(), F.transform(scope, lambda v: one(spec.fields, v, "field")))
        cols.append(X.once(items).alias("_items"))
    bad = F.when(F.col("_has") & root.isNull(), F.lit("invalid JSON"))
    out = parsed.select(*cols, bad.alias("_failed"))
    return assemble(out, spec, F.col("_failed"))
