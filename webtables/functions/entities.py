"""HTML entity decoding as a native column, so that it can run inside array lambdas.

The public entity names are one sorted literal array; a name is found in it by a binary search that only
runs for values holding an '&'. ``with_table`` names the literal once for a whole expression.
"""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions.text import let

_NEXT = "\u0001"

# Characters that numeric references 128..159 stand for (Windows-1252 order).
_C1 = (
    "\u20ac\u0081\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u008d\u017d\u008f"
    "\u0090\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u009d\u017e\u0178"
)
_LONGEST_BARE = 6  # longest entity name that is valid without a semicolon


@lru_cache(maxsize=None)
def _table() -> tuple[str, str]:
    """The standard HTML5 names (``name;`` and, where valid without a semicolon, ``name``) in byte order, and what they stand for."""
    known = sorted(html5.items())
    return _NEXT.join(k for k, _ in known), _NEXT.join(v for _, v in known)


def entity_table() -> Column:
    """``struct<names, values>``, two arrays that the optimizer folds to literals."""
    names, values = _table()
    return F.struct(F.split(F.lit(names), _NEXT).alias("names"), F.split(F.lit(values), _NEXT).alias("values"))


def with_table(body) -> Column:
    """``body(table)`` with the entity table written once into the plan."""
    return let(entity_table(), body)


def _lookup(table: Column, name: Column) -> Column:
    """What ``name`` stands for: a binary search, so that the cost grows with the digits of the table's size."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(html5).bit_length()))])

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get(table["names"], at + step) <= name, at + step).otherwise(at)

    return let(F.aggregate(steps, F.lit(0), halve), lambda at: F.when(F.get(table["names"], at) == name, F.get(table["values"], at)))


def _code_point(code: Column) -> Column:
    invalid = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    return (
        F.when(invalid, "\ufffd")
        .when(code.between(128, 159), F.substr(F.lit(_C1), (code - 127).cast("int"), F.lit(1)))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _named(piece: Column, name: Column, table: Column) -> Column:
    """Longest known name that starts the piece: all of it, or else a bare name of up to six letters."""
    size = F.length(name)

    def found(k: Column) -> Column:
        return let(_lookup(table, F.substr(name, F.lit(1), k)), lambda v: F.when(v.isNotNull(), F.concat(v, F.substr(piece, k + 2))))

    bare = F.transform(F.sequence(F.least(size, F.lit(_LONGEST_BARE)), F.lit(1), F.lit(-1)), found)
    return F.coalesce(found(size), F.get(F.filter(bare, lambda v: v.isNotNull()), F.lit(0)), piece)


_NUMERIC = r"^&#([0-9]+|[xX][0-9a-fA-F]+);?"


def _decode_piece(piece: Column, table: Column) -> Column:
    """``piece`` starts with '&' and holds no other '&'."""

    def numeric(n: Column) -> Column:
        digits = F.regexp_replace(n, "^[xX]?0*(?=.)", "")
        # More than twelve digits after the zeros are out of range in either base.
        code = F.when(F.length(digits) > 12, F.lit("999999999999")).when(n.rlike("^[xX]"), F.conv(digits, 16, 10)).otherwise(digits)
        return F.concat(_code_point(code.try_cast("bigint")), F.regexp_replace(piece, _NUMERIC, ""))

    name = F.regexp_extract(piece, r"^&([a-zA-Z0-9]+;?)", 1)
    return (
        F.when(piece.rlike(_NUMERIC), let(F.regexp_extract(piece, _NUMERIC, 1), numeric))
        .when(name != "", let(name, lambda n: _named(piece, n, table)))
        .otherwise(piece)
    )


def unescape(c: Column, table: Column | None = None) -> Column:
    """Decode every HTML entity once. Text without '&' passes untouched and costs one scan."""
    table = entity_table() if table is None else table
    decoded = F.array_join(
        F.transform(F.split(c, "(?=&)"), lambda p: F.when(p.startswith("&"), _decode_piece(p, table)).otherwise(p)),
        "",
    )
    return F.when(F.contains(c, F.lit("&")), decoded).otherwise(c)
