"""Captured pages in, results out."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions.variant import parse_json

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RESPONSES = (
    "request_id bigint, site string, task string, status int, final_url string, "
    "headers map<string,string>, body string, channel string, fetch_error string"
)

# Charset labels Spark decodes natively, with its name for each.
NATIVE_CHARSETS = {
    "utf-8": "UTF-8",
    "utf8": "UTF-8",
    "utf-16be": "UTF-16BE",
    "utf-16le": "UTF-16LE",
}
# Labels that web pages use for Windows-1252.
LATIN_LABELS = ("ascii", "us-ascii", "iso-8859-1", "iso8859-1", "latin1", "l1", "windows-1252", "cp1252")


#: Rows of a task, about, where a row is small and what follows is dear.
ROWS = 1 << 17


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Deal small rows out for a CPU-heavy step, to as many partitions as their number asks for.

    Millions of such rows are a few megabytes of a file, so splits, which go by bytes, would leave a task more rows the larger
    the table is. Counting a projection of a stored table reads no values.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // ROWS)), *keys)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a CPU-heavy step enough partitions when the input has fewer splits than cores.

    Big inputs have more splits than cores and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, path: str, site: str = "", task: str = "", channel: str = "http") -> DataFrame:
    """A table of captured pages in the ``responses`` schema; absent columns get neutral values."""
    raw = spark.read.parquet(path)
    names = set(raw.columns)

    def pick(options, default, kind):
        got = [F.col(c) for c in options if c in names]
        return (got[0] if got else default).cast(kind)

    return raw.select(
        pick(["request_id", "page_id"], F.lit(None), "bigint").alias("request_id"),
        pick(["site"], F.lit(site), "string").alias("site"),
        pick(["task"], F.lit(task), "string").alias("task"),
        pick(["status"], F.lit(200), "int").alias("status"),
        pick(["final_url", "url"], F.lit(None), "string").alias("final_url"),
        pick(["headers"], F.create_map().cast("map<string,string>"), "map<string,string>").alias("headers"),
        pick(["body", "html"], F.lit(None), "string").alias("body"),
        pick(["channel"], F.lit(channel), "string").alias("channel"),
        pick(["fetch_error"], F.lit(None), "string").alias("fetch_error"),
    )


def charset_of(content_type: Column, body: Column, sniff_bytes: int | None = None) -> Column:
    """Byte-order mark, else Content-Type, else a meta tag (anywhere, or in the first ``sniff_bytes``), else validity."""
    label = F.regexp_extract(F.lower(F.coalesce(content_type, F.lit(""))), r"charset\s*=\s*[\"']?([^\s;\"']+)", 1)
    head = F.decode(body if sniff_bytes is None else F.substring(body, 1, sniff_bytes), "ISO-8859-1")
    sniffed = F.regexp_extract(F.lower(head), r"<meta[^>]*charset\s*=\s*[\"']?([^\s;\"'/>]+)", 1)
    mark = F.hex(F.substring(body, 1, 3))
    return (
        F.when(mark == "EFBBBF", "utf-8")
        .when(mark.startswith("FEFF"), "utf-16be")
        .when(mark.startswith("FFFE"), "utf-16le")
        .when(label != "", label)
        .when(sniffed != "", sniffed)
        .when(F.is_valid_utf8(body.cast("string")), "utf-8")
        .otherwise("windows-1252")
    )


@F.arrow_udf(T.StringType())
def _decode_other(body: pa.Array, charset: pa.Array) -> pa.Array:
    """Charsets the JVM function refuses; an unknown label falls back to UTF-8, else Windows-1252."""
    import codecs

    out = []
    for b, cs in zip(body.to_pylist(), charset.to_pylist()):
        if b is None:
            out.append(None)
            continue
        try:
            out.append(b.decode(codecs.lookup(cs).name, "replace"))
        except LookupError:
            try:
                out.append(b.decode("utf-8"))
            except UnicodeDecodeError:
                out.append(b.decode("cp1252", "replace"))
    return pa.array(out, pa.string())


def latin_text(body: Column) -> Column:
    """Windows-1252 bytes as text, by way of the one-byte charset Spark knows."""
    text = F.decode(body, "ISO-8859-1")
    c1 = "".join(chr(i) for i in range(0x80, 0xA0))
    mapped = "".join(bytes([i]).decode("cp1252") if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(i) for i in range(0x80, 0xA0))
    return F.translate(text, c1, mapped)


def decode_bodies(raw: DataFrame, body: str = "body", content_type: str = "content_type", other_charsets: bool = True) -> DataFrame:
    """Raw bytes + Content-Type → text. UTF-8, UTF-16 and Latin bodies stay in the JVM.

    ``other_charsets=False`` drops the Python step for tables known to hold none.
    """
    b = F.col(body)
    tagged = raw.withColumn("_cs", charset_of(F.col(content_type), b))
    cs = F.col("_cs")
    utf8 = F.make_valid_utf8(b.cast("string"))
    out = F.when(cs.isin("utf-8", "utf8"), utf8)
    for label in ("utf-16be", "utf-16le"):
        out = out.when(cs == label, F.decode(b, NATIVE_CHARSETS[label]))
    out = out.when(cs.isin(*LATIN_LABELS), latin_text(b))
    if not other_charsets:
        return tagged.withColumn(body, out.otherwise(utf8)).drop("_cs")
    native = cs.isin(*NATIVE_CHARSETS, *LATIN_LABELS)
    # A NULL body costs the Python step nothing, so only rare charsets travel through it.
    rare = _decode_other(F.when(~native, b), F.when(~native, cs))
    return tagged.withColumn("_rare", rare).withColumn(body, F.when(native, out).otherwise(F.col("_rare"))).drop("_rare", "_cs")


def read_json_pages(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add ``json`` (VARIANT) and ``json_error`` for a body that is not JSON."""
    return responses.withColumn("json", parse_json(F.col(body))).withColumn(
        "json_error", F.when(F.col(body).isNotNull() & F.col("json").isNull(), F.lit("extract_error"))
    )


def encode_results(results: DataFrame) -> DataFrame:
    """One JSON envelope per request.

    Top-level members that are empty are left out, but for the ``data`` of a good object result, which is ``{}``
    where there is no record; NULLs inside ``data`` and ``meta`` stay.
    """
    optional = [c for c in ("url", "channel", "status", "meta", "data", "error") if c in results.columns]
    parts = [
        F.concat(F.lit('"ok":'), F.col("ok").cast("string")),
        F.concat(F.lit('"site":'), F.to_json(F.col("site").cast("variant"))),
        F.concat(F.lit('"task":'), F.to_json(F.col("task").cast("variant"))),
    ]
    for c in optional:
        kind = results.schema[c].dataType
        if isinstance(kind, T.StringType):
            text, present = F.to_json(F.col(c).cast("variant")), F.coalesce(F.col(c) != "", F.lit(False))
        elif isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            text = F.to_json(c, {"ignoreNullFields": "true" if c == "error" else "false"})
            present = F.col(c).isNotNull()
            if c == "data" and isinstance(kind, T.StructType):  # a good result without a record is the empty object
                text, present = F.coalesce(text, F.lit("{}")), present | F.col("ok")
        else:
            text, present = F.col(c).cast("string"), F.coalesce(F.col(c) != 0, F.lit(False))
        parts.append(F.when(present, F.concat(F.lit(f'"{c}":'), text)))
    keep = [c for c in ("request_id",) if c in results.columns]
    return results.select(*keep, F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def write_results(results: DataFrame, path: str) -> None:
    """JSON lines, one envelope per request, written where the rows are."""
    encode_results(results).select("value").write.text(path)


def write_page_dump(responses: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw captures before extraction, partitioned by site and task. No shuffle: every task writes its rows."""
    responses.write.mode(mode).partitionBy("site", "task").parquet(path)
