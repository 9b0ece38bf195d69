"""Lookup tables: normalised, multi-valued, ambiguity-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions import text as X
from webtables.plans.skew import keyed_join


def normalize_key(c: Column, case_sensitive: bool = False) -> Column:
    """Trimmed and, unless case-sensitive, lower-cased."""
    t = X.trim_ws(c.cast("string"))
    return t if case_sensitive else F.lower(t)


def index_keys(index: DataFrame, match: str, case_sensitive: bool = False) -> DataFrame:
    """Index rows with a ``key`` column; an array field gives one row per element, blanks none."""
    if isinstance(index.schema[match].dataType, T.ArrayType):
        elements = F.transform(F.col(match).cast("array<string>"), lambda e: normalize_key(e, case_sensitive))
        keyed = index.withColumn("key", F.explode(elements))
    else:
        keyed = index.withColumn("key", normalize_key(F.col(match), case_sensitive))
    return keyed.where(F.col("key") != "")


def lookup_table(index: DataFrame, match: str, value: str, case_sensitive: bool = False) -> DataFrame:
    """One row per key: ``n_matches``, ``n_values`` (distinct non-blank), ``value`` (the smallest).

    Two map-side-combined aggregations: a key or a value that fills a third of the index is reduced
    before it is shuffled, and no list of values is ever built.
    """
    v = F.col(value) if value in index.columns else F.lit(None).cast("string")
    pairs = index_keys(index, match, case_sensitive).select("key", X.blank_to_null(X.trim_ws(v.cast("string"))).alias("v"))
    return (
        pairs.groupBy("key", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_matches"),
            F.count("v").alias("n_values"),
            F.min("v").alias("value"),
        )
    )


def lookup_status(key: Column, n_matches: Column, n_values: Column) -> Column:
    return (
        F.when(key.isNull(), "blank")
        .when(n_matches.isNull(), "no_match")
        .when(n_values == 0, "no_value")
        .when(n_values > 1, "ambiguous")
        .otherwise("ok")
    )


def lookup_one(
    probes: DataFrame,
    index: DataFrame,
    match: str,
    value: str,
    case_sensitive: bool = False,
    probe: str = "probe",
) -> DataFrame:
    """Probes + ``value``, ``n_matches``, ``n_values``, ``status``; one output row per probe row.

    status: ok | no_match | no_value | ambiguous | blank.
    """
    table = lookup_table(index, match, value, case_sensitive)
    key = X.blank_to_null(normalize_key(F.col(probe), case_sensitive))
    joined = keyed_join(probes.withColumn("key", key), table, "key")
    status = lookup_status(F.col("key"), F.col("n_matches"), F.col("n_values"))
    return joined.select(
        *probes.columns,
        F.when(status == "ok", F.col("value")).alias("value"),
        F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"),
        F.coalesce("n_values", F.lit(0)).cast("bigint").alias("n_values"),
        status.alias("status"),
    )


def lookup_all(
    probes: DataFrame,
    index: DataFrame,
    match: str,
    case_sensitive: bool = False,
    probe: str = "probe",
) -> DataFrame:
    """Every index row per probe, with the index columns; blank probes give none.

    The result is a probe times its matches by definition.
    """
    keyed = index_keys(index, match, case_sensitive)
    left = probes.withColumn("key", X.blank_to_null(normalize_key(F.col(probe), case_sensitive))).where(
        F.col("key").isNotNull()
    )
    return keyed_join(left, keyed, "key", how="inner").drop("key")


def lookup_report(probes: DataFrame, index: DataFrame, match: str = "name", case_sensitive: bool = False, probe: str = "probe") -> tuple[DataFrame, DataFrame]:
    """Two tables for the distinct probes: ``probe, ok, count, first_pos, last_pos``, and the matches.

    ``matches``: ``probe, pos`` and the index row, in ranges of (probe, pos): the matches of a probe are neighbours, in order, and
    those of one with millions fill as many partitions as they need.
    """
    distinct = (
        probes.select(F.col(probe).alias("probe"))
        .distinct()
        .withColumn("key", X.blank_to_null(normalize_key(F.col("probe"), case_sensitive)))
    )
    keyed = index_keys(index, match, case_sensitive)
    sums = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    counts = distinct.join(sums, "key", "left").select(
        "probe",
        F.col("n").isNotNull().alias("ok"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("count"),
        "first_pos",
        "last_pos",
    )
    found = keyed_join(distinct.where(F.col("key").isNotNull()), keyed, "key", how="inner").drop("key")
    return counts, found.repartitionByRange("probe", "pos").sortWithinPartitions("probe", "pos")


def list_values(index: DataFrame, field: str = "name") -> DataFrame:
    """Non-blank trimmed display values with their index position."""
    return index.select("pos", X.trim_ws(F.col(field).cast("string")).alias("value")).where(F.col("value") != "")


def _replacements(lookup: DataFrame, lookup_name: str, lookup_value: str) -> DataFrame:
    return lookup.select(F.col(lookup_name).alias("_name"), F.col(lookup_value).alias("_found")).where(X.trim_ws(F.col("_found")) != "")


def join_list(records: DataFrame, items: str, name: str, row_id: list[str], right: DataFrame, key: str) -> DataFrame:
    """``records`` + ``_list``: for each item of the list ``items``, in order, the struct of the columns of ``right``
    whose ``key`` is the item's trimmed name (NULL fields where none is); NULL for a NULL list.

    Only names travel, under two hashes of row id and names: rows that share an id keep their own lists, and those
    that share both get the same one. The lists are put together and met on one partitioning by these hashes.
    """
    named = records.withColumn("_names", F.transform(items, lambda i: F.coalesce(X.trim_ws(i[name]), F.lit(""))))
    named = named.withColumn("_h", F.xxhash64(*row_id, "_names")).withColumn("_g", F.xxhash64(F.size("_names"), "_names", *row_id))
    flat = named.select("_h", "_g", F.posexplode("_names").alias("_pos", "_n")).select("_h", "_g", "_pos", X.blank_to_null(F.col("_n")).alias(key))
    rest = [c for c in right.columns if c != key]
    found = keyed_join(flat, right, key).groupBy("_h", "_g").agg(F.sort_array(F.collect_list(F.struct("_pos", F.struct(*rest).alias("v")))).alias("_l"))
    once = X.let(F.col("_l"), lambda a: F.filter(a, lambda e, i: (i == 0) | (F.get(a, i - 1)["_pos"] != e["_pos"])))
    back = found.select("_h", "_g", F.transform(once, lambda e: e["v"]).alias("_list"))
    out = named.join(back, ["_h", "_g"], "left")
    empty = F.array().cast(back.schema["_list"].dataType)
    return out.select(*records.columns, F.when(F.size("_names") == 0, empty).otherwise(F.col("_list")).alias("_list"))


def replace_if_found(
    records: DataFrame,
    lookup: DataFrame,
    name: str,
    target: str,
    lookup_name: str = "name",
    lookup_value: str = "url",
) -> DataFrame:
    """Overwrite ``target`` where the (case-sensitive) lookup has a non-blank value; else keep it.

    ``lookup`` holds one row per name.
    """
    left = records.withColumn("_name", X.blank_to_null(X.trim_ws(F.col(name))))
    out = keyed_join(left, _replacements(lookup, lookup_name, lookup_value), "_name")
    return out.withColumn(target, F.coalesce("_found", target)).select(*records.columns)


def replace_in_list(
    records: DataFrame,
    lookup: DataFrame,
    items: str,
    name: str = "name",
    target: str = "image",
    row_id: str = "rec_id",
    lookup_name: str = "name",
    lookup_value: str = "url",
) -> DataFrame:
    """The same over a nested record or a list of records held in column ``items``; a NULL list stays NULL."""
    kind = records.schema[items].dataType
    if isinstance(kind, T.StructType):
        flat = records.withColumn("_n", F.col(items)[name]).withColumn("_t", F.col(items)[target])
        done = replace_if_found(flat, lookup, "_n", "_t", lookup_name, lookup_value)
        return done.withColumn(items, F.when(F.col(items).isNotNull(), F.col(items).withField(target, F.col("_t")))).drop("_n", "_t")
    done = join_list(records, items, name, [row_id], _replacements(lookup, lookup_name, lookup_value), "_name")
    new = F.transform(items, lambda x, i: x.withField(target, F.coalesce(F.get("_list", i)["_found"], x[target])))
    return done.withColumn(items, new).select(*records.columns)


def lookup_or_not_found(
    requests: DataFrame,
    lookup: DataFrame,
    name: str = "name",
    lookup_name: str = "name",
    lookup_value: str = "url",
) -> DataFrame:
    """Direct lookup by name: requests + ``found_name``, ``image``, ``error struct<type,reason>``."""
    right = lookup.select(F.col(lookup_name).alias("_name"), F.col(lookup_value).alias("_found"))
    left = requests.withColumn("_name", X.blank_to_null(X.trim_ws(F.col(name))))
    out = keyed_join(left, right, "_name")
    found = X.blank_to_null(F.col("_found"))
    error = F.when(
        F.col("_name").isNull(), F.struct(F.lit("param_error").alias("type"), F.lit("name is required").alias("reason"))
    ).when(
        found.isNull(),
        F.struct(
            F.lit("not_found").alias("type"),
            F.concat(F.lit('image not found for "'), F.col("_name"), F.lit('"')).alias("reason"),
        ),
    )
    return out.select(*requests.columns, F.when(error.isNull(), F.col("_name")).alias("found_name"), found.alias("image"), error.alias("error"))
