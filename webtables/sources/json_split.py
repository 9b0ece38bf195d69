"""The items of one large JSON document, read by many tasks.

A document is cut at every ``}``, which Spark's text source can do at any split of its files, so that no task needs more than
its split. What a fragment means depends on what stands before it, but only through two facts: whether it begins inside a
string, and at which depth. Each fragment is therefore summed up for both answers to the first question:

1. per fragment: how many quotes it has, and how far its brackets lead, begun outside or inside a string;
2. per split, in the order of its fragments: running sums of these, and the sums of the whole split;
3. over the splits, a few numbers each: the prefix combination gives every split's true beginning;
4. joined back, every fragment knows its depth. The array under the key opens at depth one; an item ends where a ``}``
   leads back to the depth of the array, so fragments are numbered by the ends before them and put together by number.

Only step 3 is one task, over as many rows as the document has splits.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ["file", "block"]


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _lead(text: Column) -> Column:
    """How far the brackets of text outside strings lead; ``}`` is no part of a fragment."""
    return _count(text, "{[") - _count(text, "]")


def _alternate(parts: Column, first: int) -> Column:
    return F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")


def _effect(text: Column) -> Column:
    """``struct<quotes, out, into>``: quotes, and where the brackets lead if begun outside or inside a string."""
    parts = F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"', -1)
    return F.struct(
        (F.size(parts) - 1).cast("long").alias("quotes"),
        _lead(_alternate(parts, 0)).cast("long").alias("out"),
        _lead(_alternate(parts, 1)).cast("long").alias("into"),
    )


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, text, quotes, out, into, inside, depth``: the fragments of the document in the files of ``path``.

    ``file, block, at`` is their order, files in the order of their names. ``inside``: whether a fragment begins inside
    a string; ``depth``: the depth it begins at. A fragment's ``}`` stands behind its text, but for ``last``, the rest
    of a file that does not end in one.
    """
    rows = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"),
    )
    # A file that does not end in "}" has one fragment more than it has of these.
    ends = rows.groupBy("file").agg(
        F.max(F.struct("block", "at")).alias("end"), (F.sum(F.octet_length("text").cast("long") + 1) > F.max("size")).alias("open"),
    )
    rest = ends.where("open").select("file", "end.block", "end.at", F.lit(True).alias("last"))
    known = rows.drop("size").join(rest, ["file", "block", "at"], "left").withColumn("last", F.coalesce("last", F.lit(False)))
    known = known.withColumn("e", _effect(F.col("text"))).select("*", "e.*").drop("e")

    def closing(begun_inside: Column) -> Column:
        """1 where the ``}`` behind a fragment is outside strings."""
        ended_inside = (begun_inside.cast("long") + F.col("quotes")) % 2 == 1
        return F.when(~ended_inside & ~F.col("last"), F.lit(1)).otherwise(0)

    # Within a split, for both beginnings of the split.
    order = Window.partitionBy(*_SPLIT).orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("q", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    for name, state in (("d0", 0), ("d1", 1)):
        begun_inside = (F.col("q") + state) % 2 == 1
        known = known.withColumn(name, F.when(begun_inside, F.col("into")).otherwise(F.col("out")) - closing(begun_inside))
    for name in ("d0", "d1"):
        known = known.withColumn(f"before_{name}", F.coalesce(F.sum(name).over(before), F.lit(0)))

    # Over the splits.
    splits = known.groupBy(*_SPLIT).agg(F.sum("quotes").alias("quotes"), F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    earlier = Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("state", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("lead", F.when(F.col("state") == 1, F.col("d1")).otherwise(F.col("d0")))
    splits = splits.select(*_SPLIT, "state", F.coalesce(F.sum("lead").over(earlier), F.lit(0)).alias("from"))

    begun = known.join(splits, _SPLIT)
    inside = (F.col("q") + F.col("state")) % 2 == 1
    depth = F.col("from") + F.when(F.col("state") == 1, F.col("before_d1")).otherwise(F.col("before_d0"))
    return begun.select(*_SPLIT, "at", "text", "quotes", "out", "into", "last", inside.alias("inside"), depth.alias("depth"))


def _key_pattern(key: str) -> str:
    """The key as JSON may write it, its colon and the bracket of its array."""
    spelled = {json.dumps(key), json.dumps(key, ensure_ascii=False)}
    return r"(?<!\\)(?:" + "|".join(re.escape(s) for s in sorted(spelled)) + r")\s*:\s*\["


def array_items(spark: SparkSession, path: str, key: str) -> DataFrame:
    """``pos, item``: the texts of the objects in the array under ``key`` of the document in the files of ``path``."""
    place = F.struct("file", "block", "at")
    found = fragments(spark, path).withColumn("place", place)
    pattern = _key_pattern(key)
    # Where the key is written and an array follows; at depth one it is the one asked for.
    cut = found.where(F.col("text").rlike(pattern)).withColumn("parts", F.split("text", pattern, -1))
    tried = cut.select("place", "inside", "depth", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    head = F.array_join(F.slice("parts", F.lit(1), F.col("k")), '"":[')
    tried = tried.select("place", "inside", "depth", F.array_join(F.slice("parts", F.col("k") + 1, F.size("parts") - F.col("k")), f"{json.dumps(key)}:[").alias("rest"), _effect(head).alias("e"))
    starts = tried.where(F.col("depth") + F.when(F.col("inside"), F.col("e.into")).otherwise(F.col("e.out")) == 1)
    start = starts.agg(F.max(F.struct("place", "rest")).alias("start"))  # a repeated key: the last one
    if start.where("start IS NOT NULL").isEmpty():
        raise ValueError(f"index does not contain items key {key!r}")
    begun = found.join(F.broadcast(start), F.col("place") >= F.col("start.place"))  # one row
    opens = F.col("place") == F.col("start.place")
    begun = begun.withColumn("text", F.when(opens, F.col("start.rest")).otherwise(F.col("text"))).withColumn("begin", F.when(opens, F.lit(2)).otherwise(F.col("depth")))
    closes = (F.col("begin") == 2) & F.col("text").rlike(r"^\s*\]")
    stop = begun.where(closes).agg(F.min("place").alias("stop"))
    body = begun.join(F.broadcast(stop), F.col("stop").isNull() | (F.col("place") < F.col("stop")))  # one row
    # The fragment at which the array opens begins outside strings, whatever its first part did.
    ended_inside = (F.when(opens, F.size(F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1)) - 1).otherwise(F.col("quotes") + F.col("inside").cast("long"))) % 2 == 1
    lead = F.when(opens, _effect(F.col("text"))["out"]).when(F.col("inside"), F.col("into")).otherwise(F.col("out"))
    ends = ~ended_inside & ~F.col("last") & (F.col("begin") + lead - 1 == 2)
    body = body.select(*_SPLIT, "at", F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("}"))).alias("text"), ends.cast("long").alias("ends"))
    order = Window.partitionBy(*_SPLIT).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    body = body.withColumn("own", F.coalesce(F.sum("ends").over(order), F.lit(0)))
    totals = body.groupBy(*_SPLIT).agg(F.sum("ends").alias("ends"))
    totals = totals.select(*_SPLIT, F.coalesce(F.sum("ends").over(Window.orderBy(*_SPLIT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = body.join(totals, _SPLIT).select((F.col("base") + F.col("own")).alias("pos"), *_SPLIT, "at", "text", "ends")
    items = numbered.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct(*_SPLIT, "at", "text"))).alias("f"), F.sum("ends").alias("ends"))
    whole = F.array_join(F.transform("f", lambda x: x["text"]), "")
    item = F.regexp_replace(whole, r"^\s*,?\s*", "")
    bad = F.raise_error(F.concat(F.lit("an item of the index is no object: "), F.substring("item", 1, 40)))
    found = items.select("pos", "ends", item.alias("item")).where((F.col("ends") == 1) | (F.col("item") != ""))  # blanks before the end
    return found.select("pos", F.when((F.col("ends") == 1) & F.col("item").startswith("{"), F.col("item")).otherwise(bad.cast("string")).alias("item"))


def read_index_split(spark: SparkSession, path: str, items_key: str = "items", schema: str | None = None) -> DataFrame:
    """``read_index`` for documents of any size: ``pos`` and the fields of ``schema``, or ``item`` as a VARIANT.

    ``path`` is a file, or a folder of files whose concatenation in the order of their names is the document.
    """
    items = array_items(spark, path, (items_key or "").strip() or "items")
    if schema is None:
        return items.select("pos", F.parse_json("item").alias("item"))
    return items.select("pos", F.from_json("item", schema).alias("i")).select("pos", "i.*")
