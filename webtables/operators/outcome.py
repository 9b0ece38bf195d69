"""Response classification: which captured responses are usable, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "struct<type:string,reason:string,matched:array<string>>"
CHALLENGE_REASON = "cloudflare_or_antibot_challenge"

# Case-folded body text that marks a challenge page, and its label.
BODY_MARKERS = (
    ("just a moment", "body: Just a moment"),
    ("enable javascript and cookies to continue", "body: Enable JavaScript and cookies to continue"),
    ("cf-challenge-running", "body: cf-challenge-running"),
    ("cf-please-wait", "body: cf-please-wait"),
    ("__cf_chl_tk", "body: __cf_chl_tk"),
    ("ddos-guard", "body: ddos-guard"),
    ("access denied", "body: access denied"),
    ("人机验证", "body: 人机验证"),
    ("访问验证", "body: 访问验证"),
)
# The platform marker and what shows it is active.
PLATFORM = "challenge-platform"
PLATFORM_ACTIVE = ("_cf_chl_opt", "/cdn-cgi/challenge-platform/h/")
# Age-gate markers (the first two are case-folded, the last is exact).
AGE_GATE_FOLDED = ("enter-btn", "safeid=")
AGE_GATE_EXACT = "满18岁"
# The labels of the other rules.
HEADER_LABEL = "header: cf-mitigated=challenge"
STATUS_LABELS = {403: "status/server: 403 cloudflare", 429: "status: 429", 503: "status/server: 503 cloudflare"}
PLATFORM_LABEL = "body: active Cloudflare challenge-platform"
AGE_GATE_REASON, AGE_GATE_LABEL = "age_verification_required", "body: safe age verification page"


def header(headers: Column, name: str) -> Column:
    """Header value by case-insensitive name; empty when absent."""
    hit = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.coalesce(F.get(hit, F.lit(0))["value"], F.lit(""))


def challenge_by_header(headers: Column) -> Column:
    return F.lower(header(headers, "cf-mitigated")) == "challenge"


def challenge_by_status(status: Column, headers: Column) -> Column:
    """Labels of status rules that hold, in rule order."""
    fronted = F.contains(F.lower(header(headers, "server")), F.lit("cloudflare"))
    return F.array_compact(
        F.array(
            F.when((status == 403) & fronted, F.lit(STATUS_LABELS[403])),
            F.when(status == 429, F.lit(STATUS_LABELS[429])),
            F.when((status == 503) & fronted, F.lit(STATUS_LABELS[503])),
        )
    )


def challenge_by_body(lower_body: Column) -> Column:
    return F.array_compact(
        F.array(*[F.when(F.contains(lower_body, F.lit(n)), F.lit(label)) for n, label in BODY_MARKERS])
    )


def challenge_by_platform(lower_body: Column) -> Column:
    """An analytics-only platform script is not a challenge; an active one is."""
    active = F.contains(lower_body, F.lit(PLATFORM_ACTIVE[0])) | F.contains(lower_body, F.lit(PLATFORM_ACTIVE[1]))
    return F.contains(lower_body, F.lit(PLATFORM)) & active


def detect_challenge(status: Column, headers: Column, lower_body: Column) -> Column:
    """Ordered labels of every rule that matched; empty = not a challenge.

    The body is one pass per marker over bytes already in memory; ``lower_body`` is lowered once.
    """
    body = F.coalesce(lower_body, F.lit(""))
    return F.concat(
        F.when(challenge_by_header(headers), F.array(F.lit(HEADER_LABEL))).otherwise(
            F.array().cast("array<string>")
        ),
        F.coalesce(challenge_by_status(status, headers), F.array().cast("array<string>")),
        challenge_by_body(body),
        F.when(challenge_by_platform(body), F.array(F.lit(PLATFORM_LABEL))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def detect_age_gate(body: Column, lower_body: Column) -> Column:
    folded = F.contains(lower_body, F.lit(AGE_GATE_FOLDED[0])) & F.contains(lower_body, F.lit(AGE_GATE_FOLDED[1]))
    return F.coalesce(folded & F.contains(body, F.lit(AGE_GATE_EXACT)), F.lit(False))


def accept_status(status: Column, accepted: list[int] | None = None) -> Column:
    return F.coalesce(status.between(200, 299) | status.isin(list(accepted or [])), F.lit(False))


def make_error(type_: str, reason: Column | str, matched: Column | None = None) -> Column:
    return F.struct(
        F.lit(type_).alias("type"),
        (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"),
        (matched if matched is not None else F.lit(None).cast("array<string>")).alias("matched"),
    )


def classify(responses: DataFrame, accept: list[int] | None = None, challenge_mode: str = "detect", keep_matched: bool = False) -> DataFrame:
    """Add ``error``: NULL for a usable response, else the first rule that fails it.

    Order: challenge, age gate, fetch error, HTTP status. Extraction and output errors come later
    (``plans.task``). ``challenge_mode='off'`` skips challenge detection.
    """
    lower = responses.withColumn("_lower", F.lower("body"))
    none = F.array().cast("array<string>")
    matched = none if challenge_mode == "off" else detect_challenge(F.col("status"), F.col("headers"), F.col("_lower"))
    found = lower.withColumn("_matched", matched).withColumn("_gate", detect_age_gate(F.col("body"), F.col("_lower")))
    error = (
        F.when(F.size("_matched") > 0, make_error("blocked", CHALLENGE_REASON, F.col("_matched")))
        .when(F.col("_gate"), make_error("blocked", AGE_GATE_REASON, F.array(F.lit(AGE_GATE_LABEL))))
        .when(F.col("fetch_error").isNotNull(), make_error("fetch_error", F.col("fetch_error")))
        .when(
            ~accept_status(F.col("status"), accept),
            make_error("http_error", F.concat(F.lit("status "), F.col("status").cast("string"))),
        )
    )
    out = found.select(*responses.columns, *([F.col("_matched").alias("matched")] if keep_matched else []), error.alias("error"))
    return out


def outcome(error: Column) -> Column:
    return F.coalesce(error["type"], F.lit("ok"))
