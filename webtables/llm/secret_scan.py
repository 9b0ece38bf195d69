"""Secret scan: fixed patterns, and a battery of randomness tests over long runs of code characters.

The patterns give the base spans. The method adds spans of kind ``random``: every run of 20 or more
base64 characters is a candidate; base spans are cut out of it, and what remains between them is a
candidate each where it has 20 characters or more. Its encoding (hex, base32, lower, base36, base62, base64) is
inferred from its characters, and three statistics are taken:

* chi-squared of its symbols against a uniform alphabet;
* runs: how often the class (upper, lower, digit, other) changes, for encodings of several classes;
* serial correlation of neighbouring symbol values.

The hypothesis put to the test is "ordinary text": symbols as uneven as letters of prose and few class
changes. What chi-squared and runs say against it is measured in standard deviations, joined
(Stouffer) and turned into a p-value; both grow with the length, so a short run needs to look the
more random. A run whose serial correlation is no chance is left out (alphabets, counters). The
p-values are then held to a false-discovery rate (Benjamini-Hochberg) within each length class over
the whole corpus; p-values are counted on a grid of tenths of a power of ten, rounded up, so the rate
holds. The grid has a fixed number of cells, which is all that reaches the driver.

All of it is column expressions. Positions are code points, ends exclusive.

Defined cases: a null text is empty; empty texts have no spans; repeated rows are scanned each on its
own (and count each as a candidate of the false-discovery control); null ids are carried; an empty
table gives an empty result; other columns are carried untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.llm.common import packed, stored, text_of, unpacked

#: The base patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = (("assign", ASSIGN, 1, 8), ("access", "AKIA[A-Z0-9]{12,}", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32))
KINDS = ("assign", "access", "hex", "random")

#: Candidates of the method, and their alphabets in order of inference: name, pattern, symbols, and
#: the chance that two symbols of ordinary text are equal.
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ENCODINGS = (
    ("digits", r"^[0-9]+$", 10, 1.0),
    ("hex", r"^(?:[0-9a-f]+|[0-9A-F]+)$", 16, 0.1),
    ("lower", r"^(?:[a-z]+|[A-Z]+)$", 26, 0.066),
    ("base32", r"^[A-Z2-7]+=*$", 32, 0.066),
    ("base36", r"^(?:[a-z0-9]+|[A-Z0-9]+)$", 36, 0.065),
    ("base62", r"^[A-Za-z0-9]+$", 62, 0.065),
    ("base64", r"", 64, 0.065),
)
#: Encodings of one class of characters have no class changes to count.
ONE_CLASS = ("lower", "digits")
CHANGES = 0.35
SERIAL = 3.3
#: False-discovery rate, first lengths of the length classes, cells per power of ten and cells in all.
RATE, LENGTHS, CELLS, LAST = 0.01, (20, 32, 48, 64, 128), 10, 300
_SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"


def _found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the leftmost matches whose ``group`` has ``least`` characters: array of (start, kind, end)."""
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def step(acc, p):
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(F.coalesce(p["hit"], F.lit("")))
        new = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["hit"].alias("text")))
        good = p["hit"].isNotNull() & (F.length(p["part"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))
    found = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPANS))


def _uncovered(run: Column, base: Column) -> Column:
    """The pieces of ``run`` between spans of ``base`` (in order of their starts), of ``LEAST`` characters or more."""

    def piece(start: Column, end: Column) -> Column:
        part = F.substring(run["text"], start - run["start"] + 1, end - start)
        return F.array(F.struct(start.alias("start"), run["kind"].alias("kind"), end.alias("end"), part.alias("text")))

    def step(acc, b):
        out = F.when(b["start"] - acc["at"] >= LEAST, F.concat(acc["out"], piece(acc["at"], b["start"]))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), out.alias("out"))

    def last(acc):
        return F.when(run["end"] - acc["at"] >= LEAST, F.concat(acc["out"], piece(acc["at"], run["end"]))).otherwise(acc["out"])

    start = F.struct(run["start"].alias("at"), F.array().cast(_SPANS).alias("out"))
    inside = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.when(F.size(inside) == 0, F.array(run)).otherwise(F.aggregate(inside, start, step, last))


def _tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds ``z`` (a rational approximation, to 1e-7; coefficients are fixed values)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = 0.3989422804014327 * F.exp(-a * a / 2) * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def _tested(candidates: DataFrame) -> DataFrame:
    """``_c`` (a candidate's span) → adds ``n`` and ``cell`` of its p-value; cell 0 is never a discovery."""
    s = F.col("s")
    df = candidates.withColumn("s", F.col("_c.text")).withColumn("n", F.length("s"))
    enc = F.lit("base64")
    for name, pattern, _, _ in reversed(ENCODINGS[:-1]):
        enc = F.when(s.rlike(pattern), F.lit(name)).otherwise(enc)
    df = df.withColumn("enc", enc)
    by = lambda i: F.element_at(F.create_map(*[F.lit(x) for e in ENCODINGS for x in (e[0], float(e[i]))]), F.col("enc"))
    df = df.withColumn("k", by(2)).withColumn("equal", by(3)).withColumn("chars", F.split(s, "")).withColumn("distinct", F.array_distinct(F.split(s, "")))
    counts = F.transform("distinct", lambda c: (F.length("s") - F.length(F.replace(F.col("s"), c, F.lit("")))).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    df = df.withColumn("counts", counts).withColumn("v", F.transform("chars", lambda c: F.ascii(c).cast("double")))
    df = df.withColumn("squares", total(F.transform("counts", lambda c: c * c))).withColumn("mean", total(F.col("v")) / F.col("n"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[+/_=-]", "-"), "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "0")
    df = df.withColumn("changes", F.length(F.regexp_replace(classes, r"(.)\1*", "x")) - 1)
    df = df.withColumn("d", F.transform("v", lambda x: x - F.col("mean")))
    df = df.withColumn("lag", total(F.zip_with(F.slice("d", F.lit(1), F.col("n") - 1), F.slice("d", F.lit(2), F.col("n") - 1), lambda x, y: x * y)))
    df = df.withColumn("spread", total(F.transform("d", lambda x: x * x)))
    n, k = F.col("n").cast("double"), F.col("k")
    skew = F.col("equal") * k - 1
    chi = F.col("squares") * k / n - n
    z_chi = ((k - 1) + (n - 1) * skew - chi) / F.sqrt(2 * (k - 1) + 4 * n * skew)
    z_runs = (F.col("changes") - (n - 1) * CHANGES) / F.sqrt((n - 1) * (CHANGES * (1 - CHANGES)))
    z = F.when(F.col("enc").isin(*ONE_CLASS), z_chi).otherwise((z_chi + z_runs) / F.sqrt(F.lit(2.0)))
    serial = F.abs(F.coalesce(F.try_divide(F.col("lag"), F.col("spread")), F.lit(1.0))) * F.sqrt(n)
    cell = F.floor(-F.log10(F.greatest(_tail(z), F.lit(1e-300))) * CELLS)
    good = (F.col("enc") != "digits") & (serial <= SERIAL)
    return df.withColumn("cell", F.when(good, F.least(F.greatest(cell, F.lit(0)), F.lit(LAST))).otherwise(F.lit(0)).cast("int"))


def _class(n: Column) -> Column:
    c = F.lit(0)
    for i, low in enumerate(LENGTHS):
        c = F.when(n >= low, F.lit(i)).otherwise(c)
    return c


def thresholds(cells: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Least cell that is a discovery, by length class, of (class, cell, count) rows."""
    out = {}
    for c in range(len(LENGTHS)):
        of = {cell: n for k, cell, n in cells if k == c}
        total, seen = sum(of.values()), 0
        for cell in sorted(of, reverse=True):
            seen += of[cell]
            if cell > 0 and 10 ** (-cell / CELLS) <= rate * seen / total:
                out[c] = cell
    return out


def scan(docs: DataFrame, text: str = "text", rate: float = RATE, carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``_row`` (the input row, or its columns ``carry``) and ``spans``, an array of (start, kind, end) in order.

    ``kind`` is a place in ``KINDS``. Spans of candidates do not overlap base spans.
    """
    rows = packed(docs, text)
    row = F.struct(*[F.col("_row").getField(c).alias(c) for c in carry]) if carry else F.col("_row")
    rows = rows.select(row.alias("_row"), text_of(f"_{text}").alias("_t"))
    t = F.col("_t")
    base = F.array_sort(F.concat(*[_found(t, p, group, least, i) for i, (_, p, group, least) in enumerate(PATTERNS)]))
    rows = rows.select("_row", base.alias("base"), _found(t, CANDIDATE, 0, LEAST, 3).alias("runs"))
    rows = rows.select("_row", F.transform("base", lambda s: s.dropFields("text")).alias("base"), "runs")
    rows = rows.withColumn("runs", F.flatten(F.transform("runs", lambda r: _uncovered(r, F.col("base")))))
    return _with_discoveries(rows, rate)


def _with_discoveries(rows: DataFrame, rate: float) -> DataFrame:
    """Test the runs of every row in place, count cells over the corpus, keep the discoveries."""
    rows = stored(rows.withColumn("_id", F.monotonically_increasing_id()), "runs")
    tested = _tested(rows.select("_id", F.explode("runs").alias("_c"))).select("_id", "_c", _class(F.col("n")).alias("class"), "cell")
    tested = stored(tested, "tested")
    cells = tested.groupBy("class", "cell").count().collect()  # at most LAST + 1 cells for each of the length classes
    least = thresholds([tuple(r) for r in cells], rate)
    hit = F.lit(False)
    for c, cell in least.items():
        hit = hit | ((F.col("class") == c) & (F.col("cell") >= cell))
    more = tested.where(hit).groupBy("_id").agg(F.collect_list(F.col("_c").dropFields("text")).alias("more"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    # only rows that have candidates are joined; the others, with their texts, stay where they are
    some = rows.where(F.size("runs") > 0).join(more, "_id", "left").select("_row", F.array_sort(F.concat("base", F.coalesce("more", none))).alias("spans"))
    return some.unionByName(rows.where(F.size("runs") == 0).select("_row", F.col("base").alias("spans")))


def span_text(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", length: str | None = None, rate: float = RATE) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[secret]``; overlapping spans are one. ``length``: a column to set to the new length."""
    rows = scan(docs, text, rate)
    t = text_of("_t")

    def merge(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        new = F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(-1))), joined).otherwise(new)

    rows = rows.select("_row", F.col(f"_row.{text}").alias("_t"), F.aggregate("spans", F.array().cast("array<struct<start:int,end:int>>"), merge).alias("m"))

    def cut(acc, s):
        gap = F.substring(acc["rest"], F.lit(1), s["start"] - acc["at"])
        rest = F.substring(acc["rest"], s["end"] - acc["at"] + 1, F.length(acc["rest"]))
        return F.struct(F.concat(acc["out"], F.array(gap, F.lit("[secret]"))).alias("out"), rest.alias("rest"), s["end"].alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), t.alias("rest"), F.lit(0).alias("at"))
    clean = F.when(F.size("m") > 0, F.aggregate("m", start, cut, lambda a: F.concat(F.array_join(a["out"], ""), a["rest"]))).otherwise(F.col("_t"))
    rows = rows.select("_row", clean.alias("_t"))
    row = F.col("_row").withField(text, F.col("_t"))
    if length:
        kind = docs.schema[length].dataType
        row = row.withField(length, F.coalesce(F.length("_t").cast(kind), F.col(f"_row.{length}")))
    return unpacked(rows.select(row.alias("_row")))


def op4_randomness_battery(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(PATTERNS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("_row.doc_id", count(0), count(1), count(2), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
