"""Small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
_local: dict[str, str | None] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, rows: int = 1000) -> DataFrame:
    """``table`` for Python steps over texts: Arrow batches of at most ``rows`` rows, since texts are large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return table(spark, sf_dir, name)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local.setdefault("root", None) or tempfile.mkdtemp(prefix="llm-")
        _local["root"] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """The whole text; null is empty."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of ``text``, in order."""
    return F.filter(F.split(text, SPACE + "+", -1), lambda w: w != F.lit(""))


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` as one struct column ``_row`` plus copies of ``names`` as ``_<name>``: no later column can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[F.col(f"`{c}`").alias(f"_{c}") for c in names])


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")
