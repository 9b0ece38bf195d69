"""RE2 patterns on the JVM, against RE2 itself (DuckDB runs it)."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from webtables.functions import text as X
from webtables.functions.regex import compile_regex

TEXTS = [
    "", "a", "été ÉTÉ Été", "a$b(c", "ab\ncd\n", "x\n", "aa-bb_cc", "foo bar\tbaz\x0bq", "[a&b]^c", "{1,} a{,3} a{2}", "K k K ſ S",
    "ORD-124", "ord-7", "Τέλος λόγος", "12 %$# 34", "tab\tend", "a]b-c\\d", "ÄÖ äö ß", "line1\r\nline2", "\x01\x7f\x85\xa0", "aAbBcC", "日本 2024年", "a.b*c+d?e",
]
PATTERNS = [
    r"(?i)été", r"\Qa$b(\E", r"\Qa$b(", r"(?i:é)T(?-i:é)", r"(?i)a(?-i)b", r"(?i)k", r"a(?i)b|c", r"[a-c&&[^b]]", r"[[:alpha:]]+", r"[[:^alpha:]\d]", r"[^[:space:]\w]",
    r"[]a]+", r"[^]a]+", r"[\S]+", r"[^\S]+", r"[\W\d]", r"[a\-z]", r"[a-]", r"(?m)^\w+$", r"^\w+$", r"(?m)$", r"(?s)b.c", r"b.c", r"a{,3}", r"a{2}", r"a{1,}", r"{1",
    r"(?U)a+", r"(?U)a+?", r"\bfoo\b", r"\Bb", r"\bé", r"(?P<first_word>\w+)", r"(a)(?:b)?(?P<n>c)?", r"\x41|\x{e9}|\141", r"\pL+", r"\p{Greek}+", r"\P{L}+", r"\p{^L}", r"[\p{Lu}x]+",
    r"\v|\a|\t", r"(?:a|b)+?b", r"x*", r"(|a)b", r"\.b\*", r"[.*+?]", r"\A.", r".\z", r"(?i)[k-s]+", r"(?i)\W", r"(?i)[^a-z ]+", r"[\x{3b1}-\x{3c9}]+", r"(?i)ß", r"a\]b\-c\\d", r"[[:word:]]+",
    r"(?is)B.C", r"(?i-s:b.c)", r"日本\s(\d{4})", r"#|%", r"[#&~]", r"\{1,\}", r"a}", r"(?i)ord-([0-9]*[02468])$",
]
REFUSED = ["a**", "a++", "*a", "a{2}{3}", "(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", "(?>a)", r"(a)\1", "(a", "a)", "[a", "[b-a]", "[[:no:]]", "(?P<n>a)(?P<n>b)", "a{2,1}", "a{1001}", r"\8", r"\y", r"\é", "(?i", "(?z)a", r"\p{", "\\", r"[\d-", "(?#x)"]


def ours(spark, patterns, texts):
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    cols = []
    for k, p in enumerate(patterns):
        java, groups = compile_regex(p)
        cols.append(F.struct(F.col("t").rlike(java).alias("hit"), *[F.regexp_extract("t", java, g).alias(f"g{g}") for g in range(groups + 1)]).alias(f"p{k}"))
    out = {}
    for r in df.select("n", *cols).collect():
        for k in range(len(patterns)):
            out[r["n"], k] = tuple(r[f"p{k}"])
    return out


def theirs(patterns, texts):
    con = duckdb.connect()
    out = {}
    for k, p in enumerate(patterns):
        groups = compile_regex(p)[1]
        for n, t in enumerate(texts):
            row = con.execute("SELECT regexp_matches(?, ?)" + ", regexp_extract(?, ?, ?)" * (groups + 1), [t, p, *[x for g in range(groups + 1) for x in (t, p, g)]]).fetchone()
            out[n, k] = row
    return out


def test_answers_of_re2(spark):
    got, want = ours(spark, PATTERNS, TEXTS), theirs(PATTERNS, TEXTS)
    wrong = [(PATTERNS[k], TEXTS[n], got[n, k], want[n, k]) for n, k in want if got[n, k] != want[n, k]]
    assert not wrong, wrong[:5]


def test_random_patterns(spark):
    rng = random.Random(5)
    atoms = ["a", "b", "é", "B", ".", r"\d", r"\W", r"\s", "[ab]", "[^a]", r"[[:alnum:]é]", r"\b", "^", "$", r"\Qa.\E", "(?i)", "(?m)", "(?s)", r"\n", "-", " "]

    def pattern(depth=0):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if depth < 2 and kind < 0.3:
                out.append(rng.choice(["(", "(?:", "(?i:", "(?s-i:"]) + pattern(depth + 1) + ")" + rng.choice(["", "", "?", "*?"]))
            else:
                atom = rng.choice(atoms)
                out.append(atom + (rng.choice(["", "", "+", "{1,2}", "??"]) if atom[0] not in "^$" and not atom.startswith("(?") and atom not in (r"\b", r"\Qa.\E") else ""))
        return ("|" if rng.random() < 0.2 else "").join(out)

    patterns = [pattern() for _ in range(150)]
    texts = ["".join(rng.choices(["a", "b", "é", "É", "A", "B", "1", "_", " ", "\n", "-", "a."], k=rng.randint(0, 9))) for _ in range(25)]
    got, want = ours(spark, patterns, texts), theirs(patterns, texts)
    wrong = [(patterns[k], texts[n], got[n, k], want[n, k]) for n, k in want if got[n, k] != want[n, k]]
    assert not wrong, (len(wrong), wrong[:5])


@pytest.mark.parametrize("bad", REFUSED)
def test_refused(bad):
    with pytest.raises(ValueError):
        compile_regex(bad)


def test_all_matches(spark):
    df = spark.createDataFrame([("ÉTÉ a$b( été",)], "t string")
    row = df.select(X.extract_all(F.col("t"), "(?i)(é)t").alias("a"), X.replace_all(F.col("t"), r"\Qa$b(\E", "-").alias("r"), X.matches(F.col("t"), r"(?i)^été").alias("m")).first()
    assert (row.a, row.r, row.m) == (["É", "é"], "ÉTÉ - été", True)
