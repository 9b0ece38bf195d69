"""Index documents: JSON object files with an item array, and inline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_index(spark: SparkSession, path: str, items_key: str = "items", schema: str | None = None) -> DataFrame:
    """Rows of the array under ``items_key``, with their position ``pos``.

    The document is one JSON object, compact or pretty. Documents too large for one task should be
    kept as tables (``write_index``); this reads exchange files.
    """
    key = (items_key or "").strip() or "items"
    reader = spark.read.option("multiLine", True)
    if schema:
        reader = reader.schema(f"`{key}` array<struct<{schema}>>")
    doc = reader.json(path)
    if key not in doc.columns:
        raise ValueError(f"index does not contain items key {key!r}")
    return doc.select(F.posexplode(F.col(key)).alias("pos", "_item")).select("pos", "_item.*")


def read_index_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of a document written by ``write_index_document``, read in parallel, one item per line."""
    lines = spark.read.text(path)
    body = F.regexp_replace(F.col("value"), r"^,", "")
    return lines.where(F.col("value").rlike(r"^,?\{") & F.col("value").endswith("}")).select(F.from_json(body, schema).alias("i")).select("i.*")


def index_from_items(spark: SparkSession, items: list[dict], schema: str | None = None) -> DataFrame:
    """Inline rows as a lookup table, keeping their order as ``pos``."""
    rows = [{"pos": n, **item} for n, item in enumerate(items)]
    names = list(dict.fromkeys(k for r in rows for k in r))
    data = [tuple(r.get(n) for n in names) for r in rows]
    return spark.createDataFrame(data, schema=f"pos int, {schema}" if schema else names)


def write_index(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """The index as a table in (page, pos) order: range-partitioned, never through one task."""
    order = [*(by or []), "page", "pos"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)


def document_lines(rows: DataFrame, header: DataFrame, items_name: str = "items", meta: dict | None = None) -> DataFrame:
    """The document cut into ordered lines ``(part, page, pos, line)``: head, one line per item, tail.

    ``header`` is the one-row table of ``build_index``. No row ever holds more than one item.
    """
    item_cols = [c for c in rows.columns if c not in ("page", "pos")]
    fixed = [F.lit(v).alias(k) for k, v in (meta or {}).items()]
    head = header.select(
        F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("pos"),
        F.concat(
            F.regexp_replace(F.to_json(F.struct(*fixed, F.col("total_pages").cast("bigint").alias("total_pages"), F.col("count").cast("bigint").alias("count"))), r"\}\z", ""),
            F.lit(f',"{items_name}":['),
        ).alias("line"),
    )
    tail = header.select(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("page"), F.lit(0).cast("bigint").alias("pos"), F.lit("]}").alias("line"))
    first = rows.agg(F.min(F.struct(F.col("page").cast("bigint").alias("p"), F.col("pos").cast("bigint").alias("q"))).alias("f"))
    is_first = (F.col("page") == F.col("f.p")) & (F.col("pos") == F.col("f.q"))
    body = rows.join(F.broadcast(first), is_first, "left").select(  # one row of ``first``
        F.lit(1).alias("part"), F.col("page").cast("bigint").alias("page"), F.col("pos").cast("bigint").alias("pos"),
        F.concat(
            F.when(F.col("f").isNotNull(), F.lit("")).otherwise(","),
            F.to_json(F.struct(*item_cols), {"ignoreNullFields": "false"}),
        ).alias("line"),
    )
    return head.unionByName(body).unionByName(tail)


def write_index_document(rows: DataFrame, header: DataFrame, path: str, items_name: str = "items", meta: dict | None = None) -> None:
    """Text parts whose concatenation in name order is the JSON document."""
    lines = document_lines(rows, header, items_name, meta)
    order = ["part", "page", "pos"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
