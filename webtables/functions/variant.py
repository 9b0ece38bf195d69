"""JSON paths over VARIANT columns, and the number rules of untyped JSON."""

from __future__ import annotations

import json
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions.text import let
from webtables.plans.spec import ALL

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NONE = "array<variant>"


_NUMBER = "\0number:"
_NUMBER_TEXT = re.compile(r'"\\u0000number:([^"]*)"')


def _last_keys(body: str) -> str | None:
    """The first JSON value of a text with every repeated key but the last left out; numbers keep their digits."""

    def number(digits: str) -> str:
        return _NUMBER + digits

    def refuse(word: str):
        raise ValueError(word)

    try:
        value, _ = json.JSONDecoder(parse_int=number, parse_float=number, parse_constant=refuse).raw_decode(body.lstrip(" \t\r\n"))
        return _NUMBER_TEXT.sub(r"\1", json.dumps(value, ensure_ascii=False))
    except (ValueError, RecursionError):
        return None


@F.arrow_udf(T.StringType())
def _without_repeated_keys(body: pa.Array) -> pa.Array:
    return pa.array([None if b is None else _last_keys(b) for b in body.to_pylist()], pa.string())


def parse_json(body: Column) -> Column:
    """VARIANT, NULL when the body is not JSON. Text after the first value is ignored; of a repeated key the last one counts.

    With ``spark.sql.variant.allowDuplicateKeys`` Spark's parser does all of it. Without, bodies that it refuses, and only
    these, are read again by a small Python step that leaves out the earlier ones of repeated keys.
    """
    native = F.try_parse_json(body)
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.variant.allowDuplicateKeys", "false") == "true":
        return native
    return F.coalesce(native, F.try_parse_json(_without_repeated_keys(F.when(native.isNull(), body))))


def _literal_path(steps) -> str:
    out = "$"
    for s in steps:
        out += f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']"
    return out


def json_path(value: Column, path: tuple) -> Column:
    """All values at ``path`` as ``array<variant>``; a wrong kind, key or index gives no value."""
    if any(isinstance(s, int) and s < 0 for s in path):
        return F.array().cast(_NONE)
    runs, run = [], []
    for s in path:
        if s == ALL:
            runs += [tuple(run), ALL]
            run = []
        else:
            run.append(s)
    runs.append(tuple(run))
    # Down to the first wildcard there is one value at most.
    node = json_node(value, runs[0])
    if len(runs) == 1:
        return F.filter(F.array(node), lambda v: v.isNotNull())
    found = json_children(node)
    for r in runs[2:]:
        if r == ALL:
            found = F.flatten(F.transform(found, json_children))
        elif r:
            found = F.filter(
                F.transform(found, lambda v: F.try_variant_get(v, _literal_path(r), "variant")),
                lambda v: v.isNotNull(),
            )
    return found


def json_node(value: Column, path: tuple) -> Column:
    """The value at a path without wildcards and negative indexes; NULL where there is none."""
    return F.try_variant_get(value, _literal_path(path), "variant") if path else value


def json_children(value: Column) -> Column:
    """Array elements in order, or object values sorted by key; scalars have none."""
    members = F.try_variant_get(value, "$", "map<string,variant>")
    return F.coalesce(
        F.try_variant_get(value, "$", "array<variant>"),
        let(members, lambda m: F.transform(F.array_sort(F.map_keys(m)), lambda k: F.try_element_at(m, k))),
        F.array().cast(_NONE),
    )


def json_kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return json_kind(value).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def json_int(value: Column) -> Column:
    """64-bit integer when the JSON number is one; never a truncated fraction."""
    return F.when(json_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def json_double(value: Column) -> Column:
    """Float value of a JSON number that is not a 64-bit integer."""
    return F.when(
        is_number(value) & (json_kind(value) != "BIGINT"), F.try_variant_get(value, "$", "double")
    )


def double_text(d: Column) -> Column:
    """Shortest decimal text, exponent form outside [1e-4, 1e6) with at least two exponent digits."""
    s = d.cast("string")
    plain = F.regexp_replace(s, r"\.0$", "")
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    exponent = F.substring_index(s, "E", -1)
    scientific = F.concat(
        mantissa,
        F.when(exponent.startswith("-"), F.lit("e-")).otherwise("e+"),
        F.lpad(F.regexp_replace(exponent, "^-", ""), F.greatest(F.length(F.regexp_replace(exponent, "^-", "")), F.lit(2)), "0"),
    )
    # 1e6 <= |d| < 1e7 is written plainly by Java; move the point by hand.
    digits = F.regexp_replace(F.regexp_replace(F.abs(d).cast("string"), r"\.", ""), "0+$", "")
    million = F.concat(
        F.when(d < 0, F.lit("-")).otherwise(""),
        F.substring(digits, 1, 1),
        F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""),
        F.lit("e+06"),
    )
    small = F.regexp_replace(F.format_number(d, 20), "0+$", "")
    a = F.abs(d)
    return (
        F.when((a >= 1e6) & (a < 1e7), million)
        .when((a >= 1e-4) & (a < 1e-3), small)
        .when(F.contains(s, F.lit("E")), scientific)
        .otherwise(plain)
    )


def json_text(value: Column) -> Column:
    """Text of any JSON value; numbers follow int64-then-float, nested values are JSON text."""
    return F.when(
        json_kind(value).rlike("^(DOUBLE|FLOAT|DECIMAL)"),
        double_text(F.try_variant_get(value, "$", "double")),
    ).otherwise(F.try_variant_get(value, "$", "string"))
