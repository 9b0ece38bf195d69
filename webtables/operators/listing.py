"""Paged listings → one complete, ordered, de-duplicated index.

Every step is a keyed, map-side-combined aggregation or a join; nothing sorts or collects a whole
listing in one task. ``by`` names the columns that identify a listing when a table holds many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import text as X

#: Page numbers of a listing are written out in runs of this many.
PAGE_RUN = 1000


def _within(retries: int | None) -> Column:
    return F.lit(True) if retries is None else F.col("attempt") <= retries


def pick_attempt(attempts: DataFrame, by: list[str] | None = None, retries: int | None = None) -> DataFrame:
    """First successful attempt of each page; ``retries``: of the attempts 0 to that number only.

    Only attempt numbers are aggregated; page payloads are fetched by a join on the winning attempt,
    so they cross the network at most once.
    """
    keys = [*(by or []), "page"]
    good = attempts.where(F.col("ok") & _within(retries))
    winner = good.groupBy(*keys).agg(F.min("attempt").alias("attempt"))
    return good.join(winner, [*keys, "attempt"], "left_semi")


def items_under_key(records: DataFrame, items_key: str | None = None, task_key: str | None = None, data: str = "data") -> DataFrame:
    """Explode the item list of a page record; key precedence: given, task's, ``items``."""
    key = items_key or task_key or "items"
    names = records.schema[data].dataType.fieldNames() if hasattr(records.schema[data].dataType, "fieldNames") else []
    if key not in names:
        raise ValueError(f"data does not contain key {key!r}")
    kind = records.schema[data].dataType[key].dataType
    if kind.typeName() != "array" or kind.elementType.typeName() != "struct":
        raise ValueError(f"data.{key} has unexpected type {kind.simpleString()}")
    keep = [c for c in records.columns if c != data]
    return X.explode_rows(records, keep, F.col(data)[key]).select(*keep, "pos", "item.*")


def last_page(pages: DataFrame, by: list[str] | None = None, max_pages: int | None = None) -> DataFrame:
    """Last page of the unbroken run of non-empty pages from page 1; a gap ends the listing, and so does ``max_pages``.

    ``pages``: ``page``, ``n_items`` (by listing). One row per listing; no row when page 1 is empty
    or missing, which is an error for the caller to report (``check_complete`` does).
    """
    by = by or []
    full = pages.where((F.col("n_items") > 0) & (F.col("page") >= 1))
    full = full if max_pages is None else full.where(F.col("page") <= max_pages)
    # Each page speaks for itself and for its predecessor, so one pass finds where the run breaks.
    page = F.col("page").cast("bigint")
    spoken = full.select(*by, F.explode(F.array(F.struct(page.alias("p"), F.lit(True).alias("own")), F.struct((page - 1).alias("p"), F.lit(False).alias("own")))).alias("s"))
    known = spoken.groupBy(*by, F.col("s.p").alias("p")).agg(F.bool_or("s.own").alias("here"), F.bool_or(~F.col("s.own")).alias("followed"))
    out = known.groupBy(*by).agg(
        F.min(F.when(F.col("here") & ~F.col("followed"), F.col("p"))).alias("last_page"),
        F.bool_or((F.col("p") == 0) & F.col("followed")).alias("_first"),
    )
    return out.where("_first").drop("_first")


def check_complete(pages_ok: DataFrame, last: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pages 1..last that have no successful capture; an empty result means complete."""
    by = by or []
    have = pages_ok.select(*by, F.col("page").cast("bigint").alias("page")).distinct()
    return all_pages(last, by).join(have, [*by, "page"], "left_anti")


def all_pages(last: DataFrame, by: list[str]) -> DataFrame:
    """Pages 1..last of each listing, written out run by run so that no row holds all numbers."""
    end = F.col("last_page").cast("bigint")
    runs = last.where(end >= 1).select(*by, end.alias("_end"), F.explode(F.sequence(F.lit(1).cast("bigint"), end, F.lit(PAGE_RUN).cast("bigint"))).alias("_from"))
    return runs.select(*by, F.explode(F.sequence("_from", F.least("_end", F.col("_from") + (PAGE_RUN - 1)))).alias("page"))


def item_key(id_: Column, url: Column) -> Column:
    """Trimmed id, else trimmed url, in one key space; NULL for a keyless item."""
    return F.coalesce(X.blank_to_null(X.trim_ws(id_.cast("string"))), X.blank_to_null(X.trim_ws(url.cast("string"))))


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, whose columns name one row of a key.

    Only keys and order columns are aggregated and exchanged, with map-side combine, so a key that fills a third of the table
    is one small row per input task before the shuffle. The rows themselves are met by a semi-join with these winners.
    ``rows`` is read twice: store what is dear to compute.
    """
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    first = rows.groupBy(*keys).agg(F.min(place).alias("_first"))
    first = first.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], *([F.col("_first").alias("_o0")] if len(order) == 1 else [F.col("_first")[o].alias(f"_o{n}") for n, o in enumerate(order)]))
    same = [rows[k].eqNullSafe(first[f"_k{n}"]) for n, k in enumerate(keys)] + [rows[o].eqNullSafe(first[f"_o{n}"]) for n, o in enumerate(order)]
    return rows.join(first, same, "left_semi")


def place_key(items: DataFrame, id_: str = "id", url: str = "url") -> DataFrame:
    """``items`` + ``_key``: the item's key, or for a keyless item its own page and position."""
    own = F.concat_ws("/", F.lit("place"), F.col("page").cast("string"), F.col("pos").cast("string"))
    key = item_key(F.col(id_), F.col(url))
    return items.withColumn("_key", F.when(key.isNull(), own).otherwise(F.concat(F.lit("key/"), key)))


def merge_dedupe(items: DataFrame, by: list[str] | None = None, id_: str = "id", url: str = "url") -> DataFrame:
    """Keep the first item (page, then position) per key; keep every keyless item.

    Page and position name one item of a listing. Keyless items pass by; of the others only key and place are
    aggregated (``first_of``), the place as one number, so no buffer or exchange holds an item.
    """
    by = by or []
    key = item_key(F.col(id_), F.col(url))
    place = F.col("page").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos").cast("decimal(20,0)")
    keyed = items.withColumn("_key", key).withColumn("_place", place).where(F.col("_key").isNotNull())
    return first_of(keyed, [*by, "_key"], ["_place"]).select(*items.columns).unionByName(items.where(key.isNull()))


def page_heads(listing: DataFrame, by: list[str] | None = None, first_pass: int | None = None, items: str = "items") -> DataFrame:
    """One small row per page: winning ``attempt``, ``n_items``, and whether it is one of the ``first_pass``
    (attempts 0 to that number; all by default). No item payload is read beyond its length."""
    keys = [*(by or []), "page"]
    good = listing.where("ok")
    return (
        good.select(*keys, "attempt", F.size(items).alias("n_items"))
        .groupBy(*keys)
        .agg(F.min("attempt").alias("attempt"), F.min_by("n_items", "attempt").alias("n_items"))
        .withColumn("first_pass", _within(first_pass))
    )


def build_index(
    listing: DataFrame,
    by: list[str] | None = None,
    max_pages: int | None = None,
    first_pass: int | None = None,
    items: str = "items",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index rows, header rows, missing pages) of a captured listing.

    ``listing``: ``page``, ``attempt``, ``ok``, ``items array<struct<id,url,…>>``, one row for each attempt of a page. The
    index is valid when the third table is empty and the second has a row; ``require_complete`` turns that
    into an exception. ``first_pass``: only pages captured by that attempt say where the listing ends.

    A plan: nothing is run or written here. The listing is read once for each of heads, winners and rows, with only the columns
    each needs; pass a stored one where it is dear to compute.
    """
    by = by or []
    heads = page_heads(listing, by, first_pass, items)
    last = last_page(heads.where("first_pass"), by, max_pages)
    chosen = listing.where("ok").join(heads.select(*by, "page", "attempt"), [*by, "page", "attempt"], "left_semi")
    bounded = chosen.join(all_pages(last, by), [*by, "page"], "left_semi")
    rows = merge_dedupe(X.explode_rows(bounded, [*by, "page"], items).select(*by, "page", "pos", "item.*"), by)
    missing = check_complete(heads, last, by)
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))
    header = (
        counts.unionByName(last, allowMissingColumns=True)
        .groupBy(*by)
        .agg(F.max("count").alias("count"), F.max("last_page").alias("total_pages"))
        .where(F.col("total_pages").isNotNull())
    )
    return rows, header, missing


def require_complete(header: DataFrame, missing: DataFrame) -> None:
    """Raise like a failed build: no first page, or a page that never succeeded."""
    if header.isEmpty():
        raise ValueError("first index page returned no data")
    bad = missing.orderBy("page").head(1)
    if bad:
        raise ValueError(f"page {bad[0]['page']} returned non-ok result after retry")
