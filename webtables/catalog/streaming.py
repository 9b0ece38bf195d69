"""Streaming queries: equal to their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import LINKS, absolute, query, table
from webtables.functions import select as S
from webtables.operators.html import extract_items
from webtables.plans.scratch import scratch_path
from webtables.plans.spec import Extract, Field
from webtables.streaming.extract import stream_extract, table_files

SPEC = Extract(
    scope=S.descendant("li"),
    fields={"label": Field(S.child("a")), "abs_url": Field(S.child("a"), attr="href", resolve_url=True)},
)


@query("stream_extract", f"WITH {LINKS} SELECT page_id, pos, txt AS label, {absolute('url', 'href')} AS abs_url FROM links")
def stream_extract_(spark, sf):
    schema = table(spark, sf, "pages").schema
    path = scratch_path(spark, "stream-extract")
    out = stream_extract(spark, table_files(sf, "pages.parquet"), schema, lambda df: extract_items(df, SPEC, keep=["page_id"]), f"{path}/table", f"{path}/checkpoint")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "label", "abs_url")
