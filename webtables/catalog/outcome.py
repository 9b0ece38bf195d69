"""Response classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from webtables.catalog.base import derive, query
from webtables.catalog.fixtures import RESPONSES
from webtables.functions import select as S
from webtables.operators import outcome as O
from webtables.plans.spec import Extract, Field
from webtables.plans.task import extract_responses, shape_responses
from webtables.sources.pages import spread

R = f"r AS ({RESPONSES})"


def responses(spark, sf):
    r = derive(spark, sf, RESPONSES)
    headers = F.create_map(F.lit("Server"), F.col("server"), F.lit("CF-Mitigated"), F.col("mitigated"))
    return spread(r, "request_id").select(
        "request_id", F.lit("demo").alias("site"), F.lit("list").alias("task"), "status", "final_url", headers.alias("headers"),
        "body", F.lit("http").alias("channel"), "fetch_error",
    )


@query("challenge_by_header", f"WITH {R} SELECT request_id, lower(mitigated) = 'challenge' AS hit FROM r")
def challenge_by_header(spark, sf):
    return responses(spark, sf).select("request_id", O.challenge_by_header(F.col("headers")).alias("hit"))


STATUS_SQL = """CASE WHEN status = 403 AND lower(server) LIKE '%cloudflare%' THEN 'status/server: 403 cloudflare'
  WHEN status = 429 THEN 'status: 429' WHEN status = 503 AND lower(server) LIKE '%cloudflare%' THEN 'status/server: 503 cloudflare' ELSE '' END"""


@query("challenge_by_status", f"WITH {R} SELECT request_id, {STATUS_SQL} AS label FROM r")
def challenge_by_status(spark, sf):
    labels = O.challenge_by_status(F.col("status"), F.col("headers"))
    return responses(spark, sf).select("request_id", F.array_join(labels, ";").alias("label"))


# The texts are written out here as the pages hold them, apart from the library's list.
BODY_TEXTS = (
    "Just a moment", "Enable JavaScript and cookies to continue", "cf-challenge-running", "cf-please-wait", "__cf_chl_tk", "ddos-guard", "access denied", "人机验证", "访问验证",
)
BODY_SQL = "concat_ws(';', " + ", ".join(f"CASE WHEN contains(lower(body), lower('{t}')) THEN 'body: {t}' END" for t in BODY_TEXTS) + ")"


@query("challenge_by_body", f"WITH {R} SELECT request_id, {BODY_SQL} AS labels FROM r")
def challenge_by_body(spark, sf):
    return responses(spark, sf).select("request_id", F.array_join(O.challenge_by_body(F.lower("body")), ";").alias("labels"))


PLATFORM_SQL = "(contains(lower(body), 'challenge-platform') AND (contains(lower(body), '_cf_chl_opt') OR contains(lower(body), '/cdn-cgi/challenge-platform/h/')))"


@query("challenge_by_platform", f"WITH {R} SELECT request_id, {PLATFORM_SQL} AS hit FROM r")
def challenge_by_platform(spark, sf):
    return responses(spark, sf).select("request_id", O.challenge_by_platform(F.lower("body")).alias("hit"))


MATCHED_SQL = f"""concat_ws(';', CASE WHEN lower(mitigated) = 'challenge' THEN 'header: cf-mitigated=challenge' END, nullif({STATUS_SQL}, ''),
  nullif({BODY_SQL}, ''), CASE WHEN {PLATFORM_SQL} THEN 'body: active Cloudflare challenge-platform' END)"""
GATE_SQL = "(contains(lower(body), 'enter-btn') AND contains(lower(body), 'safeid=') AND contains(body, '满18岁'))"


@query("detect_challenge", f"WITH {R} SELECT request_id, {MATCHED_SQL} AS matched, {MATCHED_SQL} <> '' AS detected FROM r")
def detect_challenge(spark, sf):
    m = O.detect_challenge(F.col("status"), F.col("headers"), F.lower("body"))
    out = responses(spark, sf).select("request_id", m.alias("m"))
    return out.select("request_id", F.array_join("m", ";").alias("matched"), (F.size("m") > 0).alias("detected"))


@query("detect_age_gate", f"WITH {R} SELECT request_id, {GATE_SQL} AS hit FROM r")
def detect_age_gate(spark, sf):
    return responses(spark, sf).select("request_id", O.detect_age_gate(F.col("body"), F.lower("body")).alias("hit"))


@query("accept_status", f"WITH {R} SELECT request_id, status BETWEEN 200 AND 299 AS strict, status BETWEEN 200 AND 299 OR status IN (404) AS with_404 FROM r")
def accept_status(spark, sf):
    return responses(spark, sf).select("request_id", O.accept_status(F.col("status")).alias("strict"), O.accept_status(F.col("status"), [404]).alias("with_404"))


# Links must start with a letter (else the page is an extract error); a page heading without a comma
# empties the page layer, which the page format then misses (an output error).
TASK = {
    "request": {"accept_status": [404]},
    "extract": Extract(
        scope=S.descendant("li"),
        fields={"word": Field(S.child("a"), regex=r"^[A-Za-z].*", required=True)},
        page={"h1": Field(S.descendant("h1"), regex=r"(?s)^.*[aeiou]n.*$", on_missing="skip_item")},
    ),
    "output": {"format": {"w": "{word}"}, "page_format": {"head": "{h1}"}, "items_key": "words"},
}
LINKS_BAD = "regexp_matches(html, '<li><a href=\"[^\"]*\">[^A-Za-z<]')"
H1_OK = "regexp_matches(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[aeiou]n')"
OUTCOME_SQL = f"""CASE WHEN {MATCHED_SQL} <> '' OR {GATE_SQL} THEN 'blocked' WHEN fetch_error IS NOT NULL THEN 'fetch_error'
  WHEN NOT (status BETWEEN 200 AND 299 OR status = 404) THEN 'http_error' WHEN {LINKS_BAD} THEN 'extract_error' WHEN NOT {H1_OK} THEN 'output_error' ELSE 'ok' END"""


@query("classify_outcome", f"""WITH {R}, j AS (SELECT r.*, p.html FROM r JOIN pages p ON p.page_id = r.request_id), o AS (SELECT *, {OUTCOME_SQL} AS outcome, {MATCHED_SQL} AS m FROM j)
  SELECT request_id, outcome, CASE outcome WHEN 'blocked' THEN CASE WHEN m <> '' THEN 'cloudflare_or_antibot_challenge' ELSE 'age_verification_required' END
    WHEN 'fetch_error' THEN fetch_error WHEN 'http_error' THEN 'status ' || status WHEN 'extract_error' THEN 'field "word" is missing'
    WHEN 'output_error' THEN 'missing template variables: h1' END AS reason,
    CASE WHEN outcome = 'blocked' THEN CASE WHEN m <> '' THEN m ELSE 'body: safe age verification page' END END AS matched FROM o""")
def classify_outcome(spark, sf):
    done = shape_responses(extract_responses(responses(spark, sf), TASK), TASK)
    return done.select("request_id", O.outcome(F.col("error")).alias("outcome"), F.col("error.reason").alias("reason"), F.array_join("error.matched", ";").alias("matched"))
