"""One task over a table of captured responses: classify → extract → shape → count → envelope.

Page bodies never cross the network: everything up to the finished record is one narrow stage, and
only then are the (small) request rows joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webtables.functions import text as X
from webtables.operators import outcome as O
from webtables.operators.enrich import distinct_probes, kb_attach, kb_profiles
from webtables.operators.html import extract_html
from webtables.operators.json import extract_json
from webtables.operators.lookup import replace_in_list
from webtables.operators.shape import group_items, shape
from webtables.operators.wikitext import text_record
from webtables.plans.scratch import write_then_read
from webtables.plans.spec import Extract


def extract_responses(responses: DataFrame, task: dict, challenge_mode: str = "detect", body: str = "body") -> DataFrame:
    """Responses → key columns, layers and ``error struct``; blocked and failed bodies are never parsed."""
    spec: Extract = task["extract"]
    request = task.get("request") or {}
    keep = [c for c in ("request_id", "site", "task", "final_url", "channel", "status") if c in responses.columns]
    checked = O.classify(responses, request.get("accept_status"), challenge_mode).withColumnRenamed("error", "_pre")
    usable = F.when(F.col("_pre").isNull(), F.col(body))
    if spec.is_json:
        ex = extract_json(checked, spec, body=usable, keep=[*keep, "_pre"])
    else:
        ex = extract_html(checked, spec, body=usable, base="final_url", keep=[*keep, "_pre"])
    bad = F.when(F.col("error").isNotNull(), O.make_error("extract_error", F.col("error")))
    return ex.withColumn("error", F.coalesce("_pre", bad)).drop("_pre")


def shape_responses(extracted: DataFrame, task: dict) -> DataFrame:
    """Layers → ``data`` (list, object or page record), ``count``; output errors join ``error``."""
    output = task.get("output") or {}
    text_error = extracted.withColumn("_err", F.col("error")).withColumn("error", F.lit(None).cast("string"))
    shaped = shape(text_error, output["format"]) if output.get("format") else text_error
    shaped = shaped.withColumn("count", F.size("items").cast("bigint"))
    if output.get("items_key") or output.get("page_format"):
        data = group_items(shaped, output.get("page_format"), output.get("items_key") or "items")
    elif (output.get("type") or "list") == "object":
        data = shaped.withColumn("data", F.get("items", F.lit(0)))
    else:
        data = shaped.withColumn("data", F.col("items"))
    out_err = F.when(F.col("_err").isNull() & F.col("error").isNotNull(), O.make_error("output_error", F.col("error")))
    keep = [c for c in data.columns if c not in ("error", "_err", "items", "page", "data")]
    error = F.coalesce("_err", out_err)
    return data.select(*keep, F.when(error.isNull(), F.col("data")).alias("data"), error.alias("error"))


def page_meta(shaped: DataFrame, task: dict, params: Column | None) -> Column:
    """``meta`` struct: meta fields, then count, page and total when the task is paginated."""
    conf = task.get("pagination")
    fields = shaped.schema["meta"].dataType.fieldNames() if "meta" in shaped.columns else []
    parts = {f: F.col(f"meta.{f}") for f in fields}
    if conf:
        parts["count"] = F.col("count")
        if conf.get("param") and params is not None:
            raw = F.coalesce(F.try_element_at(params, F.lit(conf["param"])), F.lit(""))
            num = X.to_int(X.trim_ws(raw))
            parts["page"] = num
            parts["page_text"] = F.when(num.isNull(), raw)
        total = conf.get("total_field")
        if total and total != "total" and total in fields:
            parts["total"] = F.col(f"meta.{total}")
    if not parts:
        return F.lit(None).cast("struct<count:bigint>")
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def run_task(
    responses: DataFrame,
    task: dict,
    requests: DataFrame | None = None,
    lookup: DataFrame | None = None,
    kb: dict[str, DataFrame] | None = None,
    challenge_mode: str = "detect",
) -> DataFrame:
    """Result envelopes: request_id, ok, site, task, url, channel, status, meta, data, error.

    ``requests``: planned requests (``operators.params.plan_requests``); a request that could not be
    planned or has no capture is an error row. ``lookup`` and ``kb`` feed ``task["enhance"]``, whose ``wikitext``
    (a ``WikiSpec``) asks for the text of the profiles' pages. An enhanced task is written once to the shared folder before it is
    enriched, since enrichment reads the records several times.
    """
    done = shape_responses(extract_responses(responses, task, challenge_mode), task)
    if requests is not None:
        plan = requests.select("request_id", F.col("params").alias("_params"), F.col("url").alias("_url"), F.col("error").alias("_plan_error"))
        done = plan.join(done.withColumn("_has", F.lit(True)), "request_id", "left")
        error = (
            F.when(F.col("_plan_error").isNotNull(), O.make_error("param_error", F.col("_plan_error")))
            .when(F.col("_has").isNull(), O.make_error("fetch_error", "no response captured"))
            .otherwise(F.col("error"))
        )
        done = done.withColumn("error", error).withColumn("data", F.when(F.col("error").isNull(), F.col("data")))
        url, params = F.col("_url"), F.col("_params")
    else:
        url, params = F.col("final_url"), None
    ok = F.col("error").isNull()
    out = done.select(
        "request_id",
        ok.alias("ok"),
        *[F.col(c) for c in ("site", "task") if c in done.columns],
        url.alias("url"),
        *[F.col(c) for c in ("channel", "status") if c in done.columns],
        F.when(ok, page_meta(done, task, params)).alias("meta"),
        "data",
        "error",
    )
    if not task.get("enhance"):
        return out
    # Enrichment reads the records several times; extraction must not be repeated for each.
    return enhance(write_then_read(out, "records"), task, lookup, kb)


def enhance(results: DataFrame, task: dict, lookup: DataFrame | None, kb: dict[str, DataFrame] | None) -> DataFrame:
    """Image replacement and knowledge-base records on the items of ``data``."""
    conf, output = task.get("enhance") or {}, task.get("output") or {}
    kind = results.schema["data"].dataType
    if isinstance(kind, T.StructType):
        key = (conf.get("items_key") or output.get("items_key") or "items")
        if key not in kind.fieldNames():
            return results
        work = results.withColumn("_items", F.col("data")[key])
    else:
        key, work = None, results.withColumn("_items", F.col("data"))
    name = conf.get("name_field", "name")
    if conf.get("image_field") and lookup is not None:
        work = replace_in_list(work, lookup, "_items", name=name, target=conf["image_field"], row_id="request_id")
    if conf.get("kb_field") and kb is not None:
        names = work.select(F.explode_outer("_items").alias("i")).select(F.col(f"i.{name}").alias("name")) if isinstance(
            work.schema["_items"].dataType, T.ArrayType
        ) else work.select(F.col("_items")[name].alias("name"))
        spec = conf.get("wikitext")
        text = (lambda c: text_record(c["wikitext"], c["external_links"], spec)) if spec else None
        profiles = kb_profiles(distinct_probes(names, "name", conf.get("lang", "")), **kb, text=text)
        work = kb_attach(work, profiles, ["request_id"], name=name, target=conf["kb_field"], lang=conf.get("lang", ""), items="_items")
    data = F.col("_items") if key is None else F.when(F.col("data").isNotNull(), F.col("data").withField(key, F.col("_items")))
    return work.withColumn("data", data).drop("_items")


