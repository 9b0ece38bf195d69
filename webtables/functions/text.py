"""String columns shared by every operator: trimming, blanks, RE2-style regexes, integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions.regex import compile_regex

# The Unicode White_Space characters, in code-point order.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

def let(value: Column, body) -> Column:
    """Name an intermediate value so that ``body`` can use it twice without computing it twice."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """Pin an expensive value to the projection it is written in.

    The optimizer copies a deterministic expression into any filter or generator that reads it,
    computing it again below; a value that depends on the partition id stays where it is.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def explode_rows(df: DataFrame, keep: list[str], array: str | Column, pos: str = "pos", item: str = "item") -> DataFrame:
    """``posexplode`` that keeps no row for an empty array.

    The outer form is used because the inner one makes the optimizer re-evaluate the array in an
    added size filter.
    """
    a = F.col(array) if isinstance(array, str) else array
    return df.select(*keep, F.posexplode_outer(a).alias(pos, item)).where(F.col(pos).isNotNull())


def trim_ws(c: Column) -> Column:
    """Trim Unicode white space at both ends (SQL ``trim`` strips blanks only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    """NULL for a blank string, the untouched string otherwise."""
    return F.when(trim_ws(c) != "", c)


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_ws(c) == "", F.lit(True))


def first_non_blank(*cols: Column) -> Column:
    """First column that is not blank, kept as given; the empty string if none is."""
    return F.coalesce(*[blank_to_null(c) for c in cols], F.lit(""))


def pick_group(group: int | None, groups: int) -> int:
    """Explicit group if given, else the first group of a pattern that has one, else the match."""
    return group if group else (1 if groups else 0)


def extract_all(c: Column, pattern: str, group: int | None = None) -> Column:
    """Every match of ``pattern`` as an array (empty when nothing matches)."""
    java, groups = compile_regex(pattern)
    return F.regexp_extract_all(c, F.lit(java), F.lit(pick_group(group, groups)))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(compile_regex(pattern)[0])


def replace_all(c: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(c, compile_regex(pattern)[0], replacement)


def to_int(c: Column) -> Column:
    """Strict decimal 64-bit integer; NULL when the text is anything else (blanks included)."""
    return F.when(c.rlike(r"^[+-]?[0-9]+\z"), c.try_cast("bigint"))


def contains_fold(c: Column, needle: str) -> Column:
    return F.contains(F.lower(c), F.lit(needle))
