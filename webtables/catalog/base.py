"""Registry of the queries: each is a Spark function over the tables and, where SQL can say the same,
the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from webtables.sources.pages import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TABLES = (
    "region nation customer supplier part orders lineitem events documents pages conversations".split()
)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def tune(spark: SparkSession) -> SparkSession:
    """Session settings the operators rely on."""
    # Repeated JSON keys: the last one wins instead of the body being refused.
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # Pages are large rows: small Arrow batches keep the DOM step's memory flat.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def derive(spark: SparkSession, sf_dir: str, sql: str, *spread_by: str) -> DataFrame:
    """Run SQL over the test tables it names after FROM and JOIN.

    ``spread_by``: columns to spread rows by when the input has fewer splits than cores and the work
    that follows is CPU-heavy.
    """
    for t in TABLES:
        if re.search(rf"\b(FROM|JOIN)\s+{t}\b", sql):
            table(spark, sf_dir, t).createOrReplaceTempView(f"webtables_{t}")
    out = spark.sql(re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", r"\1 webtables_\2", sql))
    return spread(out, *spread_by) if spread_by else out


def decoded(sql: str) -> str:
    """SQL text of one HTML entity decode, for the entities the test pages hold."""
    for name, value in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">")):
        sql = f"replace({sql}, '{name}', '{value}')"
    return f"regexp_replace({sql}, '&amp;?', '&', 'g')"


LINK_RE = '<li><a href="([^"]*)">([^<]*)</a></li>'
# One row per navigation link: page_id, url, pos, href, txt.
LINKS = f"""links AS (
  SELECT page_id, url, CAST(generate_subscripts(hrefs, 1) - 1 AS BIGINT) AS pos, unnest(hrefs) AS href, unnest(txts) AS txt
  FROM (SELECT page_id, url, regexp_extract_all(html, '{LINK_RE}', 1) AS hrefs,
               regexp_extract_all(html, '{LINK_RE}', 2) AS txts FROM pages))"""


def absolute(url: str, href: str) -> str:
    """SQL text: a root-relative href against its page URL, path bytes escaped."""
    esc = f"url_encode({href})"
    for code, ch in (("%2F", "/"), ("%2C", ","), ("%26", "&"), ("%24", "$"), ("%2B", "+"), ("%3A", ":"), ("%3B", ";"), ("%3D", "="), ("%40", "@"), ("%21", "!"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        esc = f"replace({esc}, '{code}', '{ch}')"
    return f"(regexp_extract({url}, '^(https?://[^/?#]+)', 1) || {esc})"
