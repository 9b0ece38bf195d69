"""Quality rules: a threshold table compiled into one Spark projection.

Every measure of a text is a built-in column expression over its words and lines; a rule bounds the
ratio of two measures. No user function runs.

Defined cases: a null text is an empty text (0 words, base fails); a ratio whose denominator is 0
passes its rule; repeated rows are measured each on its own; rows with a null id are kept as rows;
an empty table gives an empty result; other columns of the input are carried untouched, whatever
their names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.functions.text import once
from webtables.llm.common import SPACE, WORD, packed, text_of, unpacked, words_of

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on with as be by this are or from at an a "
    "le la les de des du et un une en que pour dans qui sur pas au il "
    "der die das und ist in den von zu mit sich auf für ein nicht "
    "el los las y del se por con no para al lo una su"
).split()

#: Words in a repeated window, share of the base rule and least words.
WINDOW, REPEAT_PERCENT, LEAST_WORDS = 8, 30, 20


class Rule(NamedTuple):
    """``low <= top / bottom <= high``; either bound may be None."""

    name: str
    top: str
    bottom: str
    low: float | None
    high: float | None


#: The method's threshold table: length, symbol, stop-word and line ratios.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 0.5),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", None, 0.9),
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_stop_words", "n_lines", "n_ellipsis_lines", "n_bullet_lines",
)


def _pairs(array: str, step: int) -> Column:
    """Hash of each element with the one ``step`` places on. The last ``step`` results are not of whole windows."""
    return F.zip_with(array, F.slice(F.col(array), step + 1, F.size(array)), lambda a, b: F.xxhash64(a, b))


def _measures(df: DataFrame) -> DataFrame:
    """``_row``, ``_text`` → ``_row`` and the measures.

    Each select names arrays that the next one reads more than once, so that they are computed once.
    Repeated windows: three doublings give the hash of 8 words; only texts that hold equal hashes sort them.
    """
    line_words = F.filter(F.split(F.col("_t"), "\n", -1), lambda s: s.rlike(WORD))
    df = df.select("_row", text_of("_text").alias("_t"))
    df = df.select("_row", "_t", words_of(F.col("_t")).alias("_w"), line_words.alias("_l"))
    df = df.select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("_w", lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_l", lambda s: s.endswith("...") | s.endswith("…"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("_l", lambda s: s.rlike(r"^\s*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    rest = [c for c in df.columns if c != "_h"]
    df = df.select(*rest, _pairs("_h", 1).alias("_h2"))
    df = df.select(*rest, _pairs("_h2", 2).alias("_h4"))
    df = df.select(*rest, F.slice(_pairs("_h4", 4), F.lit(1), F.greatest(F.lit(0), F.col("n_words").cast("int") - (WINDOW - 1))).alias("_win"))
    none = F.array().cast("array<bigint>")
    df = df.select(*rest, F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.col("_win")).otherwise(none).alias("_win"))
    df = df.select(*rest, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_s"))
    same = F.zip_with("_s", F.slice(F.col("_s"), 2, F.size("_s")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    df = df.select(*rest, "_s", same.alias("_e"))
    twice = F.zip_with("_e", F.concat(F.array(F.lit(False)), F.slice(F.col("_e"), F.lit(1), F.greatest(F.lit(0), F.size("_e") - 1))), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    df = df.select(*rest, F.zip_with("_s", twice, lambda s, d: F.when(d, s["i"])).alias("_p"))
    df = df.select(*rest, F.sort_array(F.filter("_p", lambda p: p.isNotNull())).alias("_p"))
    reach = F.zip_with("_p", F.slice(F.col("_p"), 2, F.size("_p")), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("long"))
    return df.select(*rest, F.aggregate(reach, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_repeat_words"))


def _passes(rule: Rule) -> Column:
    ratio = F.try_divide(F.col(rule.top).cast("double"), F.col(rule.bottom).cast("double"))
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (ratio >= F.lit(rule.low))
    if rule.high is not None:
        ok = ok & (ratio <= F.lit(rule.high))
    return F.coalesce(ok, F.lit(True))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: ``_row`` (the input row), the measures, ``base_failed``, ``failed_rules``, ``kept``."""
    df = _measures(packed(docs, text).withColumnRenamed(f"_{text}", "_text"))
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]), lambda r: r.isNotNull())
    df = df.select("_row", *MEASURES, base.alias("base_failed"), failed.alias("failed_rules"))
    # pinned, or a filter on it would be moved below and compute the measures again, nested in each other
    return df.withColumn("kept", once(~F.col("base_failed") & (F.size("failed_rules") == 0)))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, unchanged."""
    return unpacked(judge(docs, text, rules).where("kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs)
    return out.select("_row.doc_id", *MEASURES, "base_failed", "kept")


def _rule_sql(r: Rule) -> str:
    ratio = f"CAST({r.top} AS DOUBLE) / NULLIF({r.bottom}, 0)"
    return " AND ".join([f"coalesce({ratio} >= {r.low}, TRUE)"] * (r.low is not None) + [f"coalesce({ratio} <= {r.high}, TRUE)"] * (r.high is not None))


def sql(docs: str = "documents") -> str:
    """The same judgement in DuckDB SQL over a table with ``doc_id`` and ``text``; ids must be distinct."""
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}+'), lambda w: w <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '{WORD}')) AS l FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM a WHERE len(w) >= {WINDOW})),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, CAST(sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS BIGINT) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
        CAST(len(list_filter(w, lambda x: x IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines,
        CAST(len(list_filter(l, lambda s: ends_with(s, '...') OR ends_with(s, '…'))) AS BIGINT) AS n_ellipsis_lines,
        CAST(len(list_filter(l, lambda s: regexp_matches(s, '^\\s*[-*•]'))) AS BIGINT) AS n_bullet_lines
      FROM a LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {' AND '.join(_rule_sql(r) for r in RULES)} AS kept FROM b"""
