"""Asset trees (nested JSON objects) → name/URL rows, and snapshot freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions import text as X
from webtables.functions.urls import path_escape

DEFAULT_TTL_SECONDS = 24 * 3600


def build_asset_url(base: str, group: Column, file: Column) -> Column:
    """base/Content/<escaped group>/<escaped file>, raw query re-attached when there is one."""
    name = F.substring_index(file, "?", 1)
    query = F.when(F.contains(file, F.lit("?")), F.substr(file, F.instr(file, "?") + 1)).otherwise("")
    return F.concat(
        F.lit(base.strip().rstrip("/") + "/Content/"), path_escape(group), F.lit("/"), path_escape(name),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def asset_entries(trees: DataFrame, body: str = "body", content: str = "Content") -> DataFrame:
    """Every leaf of the two-level object in document order: ``i``, ``grp``, ``j``, ``name``, ``file``.

    Maps are only exploded, never looked up by key, so repeated keys stay separate entries.
    """
    keep = [c for c in trees.columns if c != body]
    tree = F.from_json(F.get_json_object(body, f"$.{content}"), "map<string,map<string,string>>")
    outer = trees.select(*keep, F.posexplode(F.map_entries(tree)).alias("i", "g"))
    inner = outer.select(*keep, "i", F.col("g.key").alias("grp"), F.posexplode(F.map_entries("g.value")).alias("j", "e"))
    name = F.regexp_replace(F.col("e.key"), r"(?s)\.[^./]*\z", "")
    return inner.select(*keep, "i", "grp", "j", name.alias("name"), F.col("e.value").alias("file")).where(
        (X.trim_ws(F.col("name")) != "") & (X.trim_ws(F.col("file")) != "")
    )


def last_per_name(entries: DataFrame, base: str, by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Later entries override earlier ones: one ``url`` per name, by a map-side-combined ``max_by``."""
    keys, order = [*(by or []), "name"], order or ["i", "j"]
    winner = entries.groupBy(*keys).agg(F.max_by(F.struct("grp", "file"), F.struct(*order)).alias("w"))
    return winner.select(*keys, build_asset_url(base, F.col("w.grp"), F.col("w.file")).alias("url"))


def flatten_image_tree(trees: DataFrame, base: str, body: str = "body", by: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Tree documents → one row per name. ``order`` ranks entries across several documents."""
    return last_per_name(asset_entries(trees, body), base, by, order)


def snapshot_with_ttl(snapshots: DataFrame, now: Column, ttl_seconds: int = 0, key: str = "source", locator: list[str] | None = None) -> DataFrame:
    """One usable capture per source: fresh cache, else good download, else any stale cache.

    TTL 0 means the 24 h default; a negative TTL means no cache is ever fresh. Newest first within a
    class, then by ``locator``. A source without a usable capture gives no row.

    ``locator``: columns that name a row; by default ``snapshot_id`` where there is one, else the row's file and place in
    it, for a table read from files. Only rank, time and locator are aggregated; the rest of a row, its body
    above all, is read for the winners, which a join on source and locator finds.
    """
    ttl = DEFAULT_TTL_SECONDS if ttl_seconds == 0 else ttl_seconds
    if locator is None and "snapshot_id" not in snapshots.columns:
        named = snapshots.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return snapshot_with_ttl(named, now, ttl_seconds, key, ["_file", "_row"]).drop("_file", "_row")
    locator = locator or ["snapshot_id"]
    taken = F.unix_micros(F.col("captured_at").cast("timestamp"))
    age = F.unix_micros(now) - taken
    cache = F.col("kind") == "cache"
    fresh = cache & (age <= ttl * 1_000_000) if ttl >= 0 else F.lit(False)
    rank = (
        F.when(fresh, F.lit(0))
        .when((F.col("kind") == "download") & F.col("ok"), F.lit(1))
        .when(cache, F.lit(2))
    )
    usable = snapshots.select(key, rank.alias("_rank"), (-taken).alias("_newest"), *locator).where(F.col("_rank").isNotNull())
    best = usable.groupBy(key).agg(F.min(F.struct("_rank", "_newest", *locator)).alias("_b"))
    best = best.select(F.col(key).alias("_key"), F.col("_b._rank").alias("freshness"), *[F.col(f"_b.{c}").alias(f"_l{n}") for n, c in enumerate(locator)])
    same = [snapshots[key].eqNullSafe(best["_key"])] + [snapshots[c].eqNullSafe(best[f"_l{n}"]) for n, c in enumerate(locator)]
    rest = [c for c in snapshots.columns if c not in (key, "freshness")]
    return snapshots.join(best, same).select(snapshots[key], *[snapshots[c] for c in rest], "freshness")
