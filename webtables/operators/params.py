"""Request planning: a table of parameter maps → URLs, headers and cookies.

Order: defaults, index resolution, regex normalisation, required check, pagination default, request.
Index resolution therefore sees values that are not normalised yet. A parameter error is a row
value (``error``), never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import templates as P
from webtables.functions import text as X
from webtables.functions import urls as U
from webtables.operators.lookup import lookup_one


def param(name: str, params: Column | None = None) -> Column:
    return F.try_element_at(F.col("params") if params is None else params, F.lit(name))


def put(params: Column, name: str, value: Column) -> Column:
    """Map with one key set (added or overwritten); a NULL value leaves the map alone.

    ``params`` and ``value`` are repeated in the result: pass plain references where they are dear.
    """
    given = F.create_map(F.lit(name), value)
    rest = F.map_filter(params, lambda k, _: k != name)
    return F.when(value.isNull(), params).when(F.map_contains_key(params, F.lit(name)), F.map_concat(rest, given)).otherwise(F.map_concat(params, given))


def param_defaults(params: Column, spec: dict) -> Column:
    """Default only where the key is absent: a blank given value stays blank."""
    given = {n: s["default"] for n, s in spec.items() if s.get("default")}
    if not given:
        return params
    none = F.create_map().cast("map<string,string>")
    return F.map_concat(params, *[F.when(F.map_contains_key(params, F.lit(k)), none).otherwise(F.create_map(F.lit(k), F.lit(v))) for k, v in given.items()])


def normalize_param(value: Column, regex: str, group: int = 0) -> tuple[Column, Column]:
    """(normalised value, mismatch flag) for one parameter; blank values are left alone."""
    java, groups = X.compile_regex(regex)
    g = X.pick_group(group, groups)
    t = X.trim_ws(F.coalesce(value, F.lit("")))
    if g > groups:
        return value, (t != "") & t.rlike(java)
    hit = t.rlike(java)
    new = F.when((t != "") & hit, X.trim_ws(F.regexp_extract(t, java, g))).otherwise(value)
    return new, (t != "") & ~hit


def resolver_fields(target: str, resolver: dict, index: dict) -> tuple[str, str]:
    """Match and value field: resolver, then index, then the parameter's own name."""

    def pick(*names):
        return next((n for n in names if n and n.strip()), "")

    return (
        pick(resolver.get("match_field"), index.get("match_field"), resolver["from"]),
        pick(resolver.get("value_field"), index.get("value_field"), target),
    )


def resolve_params(df: DataFrame, task: dict, indexes: dict, lookups: dict[str, DataFrame]) -> DataFrame:
    """Fill blank targets from an index; adds to ``error`` on no match or ambiguity.

    All resolvers read the values as given, so their order does not matter.
    """
    given = df.withColumn("_given", F.col("params"))
    for target, resolver in sorted((task.get("resolve_params") or {}).items()):
        conf = indexes.get(resolver["index"], {})
        match, value = resolver_fields(target, resolver, conf)
        source = X.blank_to_null(X.trim_ws(param(resolver["from"], F.col("_given"))))
        wanted = X.is_blank(param(target, F.col("_given"))) & source.isNotNull()
        probed = lookup_one(
            given.withColumn("_probe", F.when(wanted, source)),
            lookups[resolver["index"]],
            match,
            value,
            conf.get("case_sensitive", False),
            probe="_probe",
        )
        tolerated = ["no_match", "no_value"] if resolver.get("optional") else []
        failed = F.col("status").isin("no_match", "no_value", "ambiguous") & ~F.col("status").isin(*tolerated or [""])
        reason = F.concat(
            F.lit(f'resolve param "{target}" from "{resolver["from"]}"="'), F.col("_probe"), F.lit('": '), F.col("status")
        )
        given = probed.withColumn("params", put(F.col("params"), target, F.col("value"))).withColumn(
            "error", F.coalesce("error", F.when(failed, reason))
        ).drop("_probe", "value", "n_matches", "n_values", "status")
    return given.drop("_given")


def normalize_params(df: DataFrame, spec: dict) -> DataFrame:
    """Regex normalisation of every parameter that has one, then the required check."""
    errs, changed = [], {}
    for name, s in sorted(spec.items()):
        if not (s.get("regex") or "").strip():
            continue
        old = F.try_element_at(F.col("params"), F.lit(name))
        new, bad = normalize_param(old, s["regex"], s.get("regex_group", 0))
        changed[name] = new
        errs.append(F.when(bad, F.concat(F.lit(f'param "{name}" value "'), X.trim_ws(old), F.lit('" does not match'))))
    rest = [c for c in df.columns if c not in ("params", "error")]
    df = df.select(*rest, "params", F.coalesce("error", *errs).alias("error"), *[v.alias(f"_new{n}") for n, v in enumerate(changed.values())])
    for n, name in enumerate(changed):
        df = df.withColumn("params", put(F.col("params"), name, F.col(f"_new{n}")))
    df = df.select(*rest, "params", "error")
    missing = [
        F.when(X.is_blank(param(name)), F.lit(f'required param "{name}" is missing'))
        for name, s in sorted(spec.items())
        if s.get("required")
    ]
    return df.withColumn("error", F.coalesce("error", *missing)) if missing else df


def pagination_default(params: Column, pagination: dict | None) -> Column:
    """Default page where the page parameter is blank or absent."""
    if not pagination or not pagination.get("param") or not pagination.get("default"):
        return params
    name = pagination["param"]
    return put(params, name, F.when(X.is_blank(F.try_element_at(params, F.lit(name))), F.lit(pagination["default"])))


def query_column(request: dict, params: Column) -> Column:
    """``array<struct<k,v>>`` of the task's query, blank values dropped if asked for."""
    omit = bool(request.get("omit_empty_query"))
    entries = [
        F.struct(F.lit(k).alias("k"), P.render_map(v, params, missing_as_empty=omit).alias("v"))
        for k, v in sorted((request.get("query") or {}).items())
    ]
    if not entries:
        return F.array().cast("array<struct<k:string,v:string>>")
    arr = F.array(*entries)
    return F.filter(arr, lambda e: X.trim_ws(e["v"]) != "") if omit else arr


def query_text(request: dict, params: Column) -> Column:
    """The encoded query of ``query_column``. Names are known when the plan is made, so nothing is sorted per row."""
    omit = bool(request.get("omit_empty_query"))
    parts = []
    for k, v in sorted((request.get("query") or {}).items()):
        value = P.render_map(v, params, missing_as_empty=omit)
        part = F.concat(U.form_escape(F.lit(k)), F.lit("="), U.form_escape(value))
        parts.append(F.when(X.trim_ws(value) != "", part) if omit else part)
    return F.concat_ws("&", *parts) if parts else F.lit("")


def build_url(base_url: str, request: dict, params: Column) -> Column:
    """Full-URL template, or path template against the base; then the query."""
    if request.get("url"):
        url = U.normalize_url(P.render_map(request["url"], params))
    else:
        raw = P.render_map(request.get("path", ""), params)
        url = U.resolve_url(F.lit(base_url), raw)
    full = X.let(url, lambda u: U.with_query(u, query_column(request, params)))
    origin = U.origin_of(base_url)
    if request.get("url") or origin is None:
        return full
    # Most paths need no parsing, and plain columns are compiled where lambdas are interpreted.
    text = query_text(request, params)
    plain = F.concat(F.lit(origin), raw, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))
    return F.when(U.is_plain_path(raw), plain).otherwise(full)


def merge_headers(defaults: dict | None, task: dict | None, params: Column) -> Column:
    """Site headers overlaid by task headers, values rendered."""
    merged = {**(defaults or {}), **(task or {})}
    if not merged:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[x for k, v in merged.items() for x in (F.lit(k), P.render_map(v, params))])


def merge_header_maps(defaults: Column, task: Column) -> Column:
    """The same for header maps that are columns."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(task, k)), task)


def choose_cookie(runtime: Column, default: Column) -> Column:
    """Runtime cookie if not blank, else the site default."""
    return F.coalesce(X.blank_to_null(runtime), default)


def parse_cookies(header: Column) -> Column:
    """Cookie header → ``array<struct<name,value>>``; parts without '=' are dropped."""
    parts = F.filter(F.transform(F.split(header, ";"), X.trim_ws), lambda p: F.contains(p, F.lit("=")))
    return F.transform(
        parts,
        lambda p: F.struct(
            X.trim_ws(F.substring_index(p, "=", 1)).alias("name"),
            X.trim_ws(F.substr(p, F.instr(p, "=") + 1)).alias("value"),
        ),
    )


def plan_requests(
    params: DataFrame,
    task: dict,
    site: dict,
    lookups: dict[str, DataFrame] | None = None,
    cookie: str | None = None,
) -> DataFrame:
    """Parameter rows → ``params`` (final), ``method``, ``url``, ``headers``, ``cookie``, ``error``."""
    spec, request = task.get("params") or {}, task.get("request") or {}
    keep = [c for c in params.columns if c not in ("params", "error", "cookie")]
    df = params.select(
        *keep,
        *([F.col(cookie).alias("_cookie")] if cookie else []),
        param_defaults(F.col("params"), spec).alias("params"),
        F.lit(None).cast("string").alias("error"),
    )
    if task.get("resolve_params"):
        df = resolve_params(df, task, site.get("indexes") or {}, lookups or {})
    df = normalize_params(df, spec)
    df = df.withColumn("params", pagination_default(F.col("params"), task.get("pagination")))
    p = F.col("params")
    defaults = site.get("defaults") or {}
    templates = [request.get("url") or request.get("path", ""), *(defaults.get("headers") or {}).values(), *(task.get("headers") or {}).values()]
    if not request.get("omit_empty_query"):
        templates += list((request.get("query") or {}).values())
    absent = [F.when(P.missing_keys(t, p) != "", F.concat(F.lit("missing template variables: "), P.missing_keys(t, p))) for t in templates if P.placeholders(t)]
    site_cookie = F.lit(None).cast("string")
    if (defaults.get("cookie") or "").strip():
        site_cookie = P.render_map(defaults["cookie"], p)
        lacking = P.missing_keys(defaults["cookie"], p)
        # The site cookie is only rendered, and can only fail, when the request brings none.
        needed = (lacking != "") & (X.is_blank(F.col("_cookie")) if cookie else F.lit(True))
        absent.append(F.when(needed, F.concat(F.lit("missing template variables: "), lacking)))
    error = F.coalesce("error", *absent)
    chosen = choose_cookie(F.col("_cookie"), site_cookie) if cookie else site_cookie
    method = (request.get("method") or "").strip().upper() or "GET"
    ready = df.select(*keep, "params", F.lit(method).alias("method"), build_url(site.get("base_url", ""), request, p).alias("url"),
                      merge_headers(defaults.get("headers"), task.get("headers"), p).alias("headers"), chosen.alias("cookie"), error.alias("error"))
    ok = F.col("error").isNull()
    return ready.select(*keep, "params", "method", F.when(ok, F.col("url")).alias("url"), F.when(ok, F.col("headers")).alias("headers"), "cookie", "error")
