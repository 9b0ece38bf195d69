"""URL columns: reference resolution (RFC 3986), query encoding, path escaping."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webtables.functions.text import let

_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Characters a URL path / fragment may hold unescaped.
_PATH_OK = r"A-Za-z0-9\-_.~!$&'()*+,;=:@/\[\]%"
_FRAGMENT_OK = r"A-Za-z0-9\-_.~!$&'()*+,;=:@/?\[\]%"
# Characters kept when one path *segment* is escaped.
_SEGMENT_OK = r"A-Za-z0-9\-_.~$&+=:@"


def _percent(c: Column, allowed: str) -> Column:
    """Percent-encode the UTF-8 bytes of each character outside ``allowed``; ``c`` is a plain reference."""
    encoded = F.array_join(
        F.transform(
            F.split(c, "(?!^)"),
            lambda ch: F.when(ch.rlike(f"^[{allowed}]$"), ch).otherwise(
                F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )
    return F.when(c.rlike(f"^[{allowed}]*\\z"), c).otherwise(encoded)


def parse_url(c: Column) -> Column:
    """scheme, authority, path, query, fragment plus presence flags, as one struct."""
    head = F.substring_index(c, "#", 1)
    return F.struct(
        F.lower(F.regexp_extract(c, _URL, 1)).alias("scheme"),
        F.regexp_extract(c, _URL, 2).alias("authority"),
        c.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//").alias("has_authority"),
        F.regexp_extract(c, _URL, 3).alias("path"),
        F.contains(head, F.lit("?")).alias("has_query"),
        F.regexp_extract(c, _URL, 4).alias("query"),
        F.regexp_extract(c, _URL, 5).alias("fragment"),
    )


def _unparse(u: Column) -> Column:
    """Text of a URL struct; ``u`` is a plain reference."""
    path = u["path"]
    return F.concat(
        F.when(u["scheme"] != "", F.concat(u["scheme"], F.lit(":"))).otherwise(""),
        F.when(
            u["has_authority"],
            F.concat(F.lit("//"), u["authority"], F.when((path != "") & ~path.startswith("/"), F.lit("/")).otherwise("")),
        ).otherwise(""),
        _percent(path, _PATH_OK),
        F.when(u["has_query"], F.concat(F.lit("?"), u["query"])).otherwise(""),
        F.when(u["fragment"] != "", F.concat(F.lit("#"), _percent(u["fragment"], _FRAGMENT_OK))).otherwise(""),
    )


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 5.2.4 over the '/'-separated segments; a path without dot segments is one regex test."""

    def fold(parts: Column) -> Column:
        kept = F.aggregate(
            parts,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1))))
            .otherwise(F.array_append(acc, s)),
        )
        tail = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise("")
        joined = F.concat(F.array_join(kept, "/"), tail)
        return F.regexp_replace(joined, r"^/?", "/")

    return let(path, lambda p: F.when(p.rlike(r"(^|/)\.\.?(/|\z)"), let(F.split(p, "/"), fold)).otherwise(p))


def url_error(raw: Column) -> Column:
    """Why ``raw`` is not a URL reference at all; NULL when it is one."""
    bad_escape = F.regexp_replace(raw, "%[0-9a-fA-F]{2}", "")
    return (
        F.when(raw.rlike(r"[\x00-\x1f\x7f]"), F.lit("control character in URL"))
        .when(raw.startswith(":"), F.lit("missing protocol scheme"))
        .when(
            raw.rlike(r"^[^/?#:]*:") & ~raw.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"),
            F.lit("first path segment contains a colon"),
        )
        .when(
            F.contains(F.regexp_replace(bad_escape, r"\?[^#]*", ""), F.lit("%")),
            F.lit("invalid URL escape"),
        )
    )


def resolve_url(base: Column, raw: Column) -> Column:
    """``raw`` against ``base``; absolute URLs are only normalised. Chains no UDF."""

    def relative(b: Column, r: Column) -> Column:
        """The URL struct of ``r`` seen from ``b``."""
        empty = (r["path"] == "") & ~r["has_authority"]
        bare = empty & ~r["has_query"]
        merged = F.concat(F.regexp_replace(b["path"], r"(?s)[^/]*\z", ""), r["path"])
        path = (
            F.when(r["has_authority"] | r["path"].startswith("/"), r["path"])
            .when(empty, b["path"])
            .when(merged.startswith("/"), merged)
            .otherwise(F.concat(F.lit("/"), merged))
        )
        return F.struct(
            b["scheme"].alias("scheme"),
            F.when(r["has_authority"], r["authority"]).otherwise(b["authority"]).alias("authority"),
            (b["has_authority"] | r["has_authority"]).alias("has_authority"),
            remove_dot_segments(path).alias("path"),
            F.when(bare, b["has_query"]).otherwise(r["has_query"]).alias("has_query"),
            F.when(bare, b["query"]).otherwise(r["query"]).alias("query"),
            F.when(bare & (r["fragment"] == ""), b["fragment"]).otherwise(r["fragment"]).alias("fragment"),
        )

    def join(r: Column) -> Column:
        own = F.when(r["scheme"] != "", r).otherwise(let(parse_url(base), lambda b: relative(b, r)))
        return let(own, _unparse)

    return let(parse_url(raw), join)


def origin_of(base: str) -> str | None:
    """Scheme and authority of a base that has both."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)", base)
    return m and f"{m[1].lower()}://{m[2]}"


def is_plain_path(raw: Column) -> Column:
    """An absolute path that resolves to itself: no authority, query, fragment, dot segment or character to be escaped."""
    return raw.rlike(f"^/(?!/)[{_PATH_OK}]*\\z") & ~raw.rlike(r"/\.\.?(/|\z)")


def normalize_url(c: Column) -> Column:
    """The URL itself with its scheme lower-cased and its path and fragment escaped."""
    return let(parse_url(c), _unparse)


def path_escape(c: Column) -> Column:
    """Escape one path segment ('/' included)."""
    return _percent(c, _SEGMENT_OK)


def form_escape(c: Column) -> Column:
    """``application/x-www-form-urlencoded`` with '~' kept and '*' escaped."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def form_unescape(c: Column) -> Column:
    return F.try_url_decode(c)


def encode_query(entries: Column) -> Column:
    """``array<struct<k,v>>`` → query text sorted by key; keys are expected to be distinct."""
    return F.array_join(
        F.transform(
            F.array_sort(entries, lambda a, b: F.when(a.k < b.k, -1).when(a.k > b.k, 1).otherwise(0)),
            lambda e: F.concat(form_escape(e.k), F.lit("="), form_escape(e.v)),
        ),
        "&",
    )


def query_entries(url: Column) -> Column:
    """The query already present in a URL, as ``array<struct<k,v>>`` (undecodable pairs dropped)."""
    raw = F.regexp_extract(url, _URL, 4)
    pairs = F.filter(F.split(raw, "&"), lambda p: (p != "") & ~F.contains(p, F.lit(";")))
    return F.filter(
        F.transform(
            pairs,
            lambda p: F.struct(
                form_unescape(F.substring_index(p, "=", 1)).alias("k"),
                form_unescape(F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v"),
            ),
        ),
        lambda e: e.k.isNotNull() & e.v.isNotNull(),
    )


def with_query(url: Column, entries: Column) -> Column:
    """Set ``entries`` on ``url``: keys already in its query are overridden, the rest are kept."""

    def build(e: Column) -> Column:
        kept = F.filter(query_entries(url), lambda q: ~F.exists(e, lambda x: x.k == q.k))
        encoded = encode_query(F.concat(kept, e))
        bare = F.regexp_replace(url, r"(?s)\?[^#]*", "")
        head = F.substring_index(bare, "#", 1)
        tail = F.when(F.contains(bare, F.lit("#")), F.substr(bare, F.instr(bare, "#"))).otherwise("")
        return F.concat(head, F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(""), tail)

    return let(entries, build)
