"""HTML extraction: captured pages → metadata, page record and item records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import dom as D
from webtables.functions import text as X
from webtables.functions.entities import unescape, with_table
from webtables.functions.urls import resolve_url, url_error
from webtables.operators.layers import assemble, layer
from webtables.plans.spec import Extract, Field


def with_dom(pages: DataFrame, body: str | Column = "html", with_html: bool = True, name: str = "dom") -> DataFrame:
    """Add the parsed page; the only Python step of HTML extraction."""
    return pages.withColumn(name, D.parse_dom(F.col(body) if isinstance(body, str) else body, with_html))


def dom_nodes(pages: DataFrame, dom: str = "dom") -> DataFrame:
    """One row per node, with its text, next to the columns of ``pages``."""
    keep = [c for c in pages.columns if c != dom]
    d = F.col(dom)
    nodes = F.transform(
        d["nodes"],
        lambda n: F.struct(
            n["pre"].alias("pre"),
            n["parent"].alias("parent"),
            n["last"].alias("last"),
            n["tag"].alias("tag"),
            n["attrs"].alias("attrs"),
        ),
    )
    return X.explode_rows(pages, keep, nodes, "_i", "_n").select(*keep, "_n.*")


def _raw(rule: Field, dom: Column, node: Column) -> Column:
    if rule.attr in ("", "text"):
        return D.node_text(dom, node)
    if rule.attr == "html":
        return D.node_inner_html(dom, node)
    if rule.attr == "outer_html":
        return D.node_outer_html(dom, node)
    return D.node_attr(node, rule.attr)


def _bad_group(rule: Field) -> tuple[str | None, int, str | None]:
    """(Java pattern, group, complaint): a group the pattern lacks is an error once something matches."""
    if not rule.regex:
        return None, 0, None
    java, groups = X.compile_regex(rule.regex)
    group = X.pick_group(rule.group, groups)
    return java, group, f"regex_group {group} out of range for {rule.regex!r}" if group > groups else None


def raw_values(rule: Field, dom: Column, context: Column) -> Column:
    """Texts a rule reads in ``context``: the first node's, or every node's with ``multiple``."""
    java, group, complaint = _bad_group(rule)

    def of_node(node: Column) -> Column:
        raw = F.coalesce(_raw(rule, dom, node), F.lit(""))
        if rule.trim:
            raw = X.trim_ws(raw)
        if java is None:
            return F.array(raw)
        if complaint:
            return F.when(raw.rlike(java), F.array(raw)).otherwise(F.array().cast("array<string>"))
        return F.regexp_extract_all(raw, F.lit(java), F.lit(group))

    if rule.select is None:
        return F.array().cast("array<string>")
    nodes = rule.select.apply(dom, context, only_first=not rule.multiple)
    if not rule.multiple:
        nodes = F.slice(nodes, 1, 1)
    return F.flatten(F.transform(nodes, of_node))


def field_value(rule: Field, decoded: Column, base: Column | None) -> Column:
    """``struct<v, err>`` from the decoded texts of a rule; NULL ``v`` without ``err`` means missing."""
    complaint = _bad_group(rule)[2]
    texts = F.filter(F.transform(decoded, X.trim_ws) if rule.trim else decoded, lambda v: v != "")

    def finish(v: Column) -> Column:
        err = F.lit(complaint).cast("string")
        if rule.resolve_url and base is not None:
            err = F.coalesce(err, url_error(v))
            v = resolve_url(base, v)
        if rule.is_int:
            n = X.to_int(v)
            err = F.coalesce(err, F.when(n.isNull(), F.concat(F.lit('convert "'), v, F.lit('" to int'))))
            v = n.cast("string") if rule.multiple else n
        return F.struct(v.alias("v"), err.alias("err"))

    def pick(vals: Column) -> Column:
        err = F.get(F.filter(vals, lambda x: x["err"].isNotNull()), F.lit(0))["err"]
        return F.struct(_first_or_all(rule, F.transform(vals, lambda x: x["v"])).alias("v"), err.alias("err"))

    if not (complaint or rule.is_int or (rule.resolve_url and base is not None)):
        return X.let(texts, lambda t: F.struct(_first_or_all(rule, t).alias("v"), F.lit(None).cast("string").alias("err")))
    return X.let(F.transform(texts, finish), pick)


def _first_or_all(rule: Field, values: Column) -> Column:
    return F.when(F.size(values) > 0, values) if rule.multiple else F.get(values, F.lit(0))


def extract_html(
    pages: DataFrame, spec: Extract, body: str | Column = "html", base: str | None = "url", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns + ``meta``, ``page``, ``items``, ``error``, one row per page, no shuffle.

    A NULL body passes through with NULL results, so blocked pages are never parsed. Page text and
    markup are dropped before anything is exploded.
    """
    keep = [c for c in pages.columns if c not in (body, "html", "body")] if keep is None else keep
    base_col = F.col(base) if base else None
    parsed = pages.select(
        *[F.col(c) for c in dict.fromkeys([*keep, *([base] if base else [])])],
        D.parse_dom(F.col(body) if isinstance(body, str) else body, spec.reads_markup).alias("_dom"),
    )
    d = F.col("_dom")
    root = F.get(d["nodes"], F.lit(0))
    scope = spec.scope.apply(d, root) if spec.scope is not None else F.array(root)

    def one(fields, context, noun, table):
        at = {n: i for i, n in enumerate(fields)}
        raw = F.array(*[raw_values(rule, d, context) for rule in fields.values()])
        decoded = F.transform(raw, lambda texts: F.transform(texts, lambda t: unescape(t, table)))
        return X.let(
            decoded,
            lambda v: layer(fields, lambda n, rule: field_value(rule, F.get(v, F.lit(at[n])), base_col), noun),
        )

    layers = []
    if spec.meta:
        layers.append(("_meta", lambda t: one(spec.meta, root, "meta", t)))
    if spec.page:
        layers.append(("_page", lambda t: one(spec.page, root, "field", t)))
    if spec.fields:
        layers.append(("_items", lambda t: F.transform(scope, lambda n: one(spec.fields, n, "field", t))))
    cols = [F.col(c) for c in keep]
    cols += [X.once(F.when(d.isNotNull(), with_table(build))).alias(name) for name, build in layers]
    return assemble(parsed.select(*cols), spec, F.lit(None).cast("string"))


def extract_items(pages: DataFrame, spec: Extract, **kwargs) -> DataFrame:
    """One row per item with its position; failed pages yield no rows."""
    return explode_items(extract_html(pages, spec, **kwargs))


def explode_items(extracted: DataFrame) -> DataFrame:
    keep = [c for c in extracted.columns if c not in ("items", "error", "meta", "page")]
    return X.explode_rows(extracted, keep, "items").select(*keep, "pos", "item.*")
