"""Merkle manifest of a table: every row a leaf, an eight-ary tree per language, a tree over the languages.

``H`` is the lower-case hexadecimal sha256 of its inputs concatenated, digests as hexadecimal text. A leaf is
``H`` of the row's fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and its value. The leaves
of a tree stand in order; while there are several nodes, every ``FAN`` consecutive ones become their ``H``.

1. Leaves are made by column functions and written, 32 bytes each, so texts are read once and never shuffled.
2. They are dealt by ranges of (tree, order) and sorted; a row's position is its place in its range plus the
   rows of its tree in the ranges before: one number for each range and tree.
3. ``FAN ** LEVELS`` consecutive leaves are a superblock, whose subtree is reduced in one group. The roots of all
   superblocks are the nodes of the next tier, and so on: each tier is that many times smaller.
4. Downwards, each superblock gets the one row of outer nodes that its leaves need: the siblings on the path from
   its root to the top. Nodes and outer row are cogrouped by superblock; the group repeats its own reduction,
   joins inner and outer siblings to proofs, and folds a leaf along its proof, all in one step.

A group holds these nodes and one path, however large the table or a language is. What is written between
steps is in the folder of ``spark.checkpoint.dir``, so a lost executor repeats its own groups only.

A path is bytes: for each level the node's place in its run, the number of its siblings, and their digests.

Defined cases: null fields are ``-``; an empty text is ``0:``; texts of any length are hashed whole by Spark; rows of one
id are ordered by their leaves, equal rows stand side by side and each has a proof of its own; rows without id come
first and are not tampered with; an empty table gives no rows; other columns are not read; a name that occurs
twice cannot be read and is Spark's own error.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm.common import stored, table

FAN = 8
#: Levels that one superblock reduces; it holds ``FAN ** LEVELS`` nodes.
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hashed(digests: list[bytes]) -> bytes:
    """``H`` of digests."""
    return sha256("".join([d.hex() for d in digests]).encode()).digest()


def levels_of(n: int) -> int:
    """Levels after which ``n`` nodes are one."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


def reduced(digests: list[bytes], n: int, height: int) -> list[list[bytes]]:
    """The levels of a superblock of at most ``height`` from its nodes to its root, in a tree of ``n`` nodes at this tier."""
    out = [digests]
    for _ in range(min(height, levels_of(n))):
        below = out[-1]
        out.append([hashed(below[k : k + FAN]) for k in range(0, len(below), FAN)])
    return out


def path_of(levels: list[list[bytes]], at: int) -> bytes:
    """Siblings of node ``at`` and of its ancestors below the root of the superblock."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % FAN
        run = nodes[first : first + FAN]
        out += [bytes([at - first, len(run) - 1]), *run[: at - first], *run[at - first + 1 :]]
        at //= FAN
    return b"".join(out)


def siblings(path: bytes):
    """Yield (place, digests of the siblings) of each level."""
    at = 0
    while at < len(path):
        place, n = path[at], path[at + 1]
        yield place, [path[at + 2 + 32 * k : at + 34 + 32 * k] for k in range(n)]
        at += 2 + 32 * n


def folded(digest: bytes, path: bytes) -> bytes:
    """The root that ``digest`` leads to along ``path``."""
    for place, others in siblings(path):
        digest = hashed([*others[:place], digest, *others[place:]])
    return digest


def proof_hash(path: bytes) -> str:
    return hashed([d for _, others in siblings(path) for d in others]).hex()


def field(value: Column) -> Column:
    """``-`` for null, else length in bytes, ``:`` and value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def positions(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the place among rows of the same ``tree`` in ascending ``order``, and ``n``, their number.

    The places within a range are counted by Spark's own row ids, which follow the sorted rows.
    """
    keys = ["tree", *order]
    dealt = rows.repartitionByRange(*keys, "place").sortWithinPartitions(*keys, "place")
    dealt = stored(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), name)
    ranges = dealt.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = Window.partitionBy("tree").orderBy("part")
    ranges = ranges.select(
        "tree", "part", "first",
        (F.sum("rows").over(before) - F.col("rows")).alias("base"),
        F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
    )
    placed = dealt.join(ranges, ["tree", "part"])
    return placed.withColumn("pos", F.col("base") + F.col("at") - F.col("first")).drop("part", "at", "first", "base", "place")


def _super(height: int) -> Column:
    return F.expr(f"pos div {FAN**height}")


def upper_tier(nodes: DataFrame, name: str, height: int) -> DataFrame:
    """Roots of the superblocks of ``nodes`` (tree, pos, n, digest) as the nodes of the next tier."""

    def root(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        n = int(group["n"].iloc[0])
        top = reduced([bytes(d) for d in group["digest"]], n, height)[-1]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n // FAN**height)], "digest": [top[0]]})

    grouped = nodes.select("tree", _super(height).alias("block"), "pos", "n", "digest").groupBy("tree", "block")
    return stored(grouped.applyInPandas(root, "tree string, pos long, n long, digest binary"), name)


def with_paths(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """(tree, pos, path, top, root) of ``nodes``; ``outer`` has path, top and root of each superblock (tree, block)."""

    def join(key, group: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        levels = reduced([bytes(d) for d in group["digest"]], int(group["n"].iloc[0]), height)
        path, top, root = out[["path", "top", "root"]].iloc[0]
        paths = [path_of(levels, k) + bytes(path) for k in range(len(group))]
        return pd.DataFrame({"tree": group["tree"], "pos": group["pos"], "path": paths, "top": [bytes(top)] * len(group), "root": [bytes(root)] * len(group)})

    left = nodes.select("tree", _super(height).alias("block"), "pos", "n", "digest").groupBy("tree", "block")
    right = outer.groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(join, "tree string, pos long, path binary, top binary, root binary")


def proofs(leaves: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """The last exchange: leaves with their superblock's outer nodes, to proofs and folded roots."""

    def join(key, group: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        digests = [bytes(d) for d in group["digest"]]
        levels = reduced(digests, int(group["n"].iloc[0]), height)
        outer_path, top, root = (bytes(v) for v in out[["path", "top", "root"]].iloc[0])
        paths = [path_of(levels, k) for k in range(len(digests))]
        known: dict[bytes, bytes] = {}  # root of the superblock → root of all, along the outer path
        ends = []
        for d, path in zip(group["presented"], paths):
            mid = folded(bytes(d), path)
            if mid not in known:
                known[mid] = folded(mid, outer_path)
            ends.append(known[mid])
        return pd.DataFrame({
            "doc_id": group["doc_id"].astype("Int64"),
            "leaf": [d.hex() for d in digests],
            "subroot": top.hex(),
            "root": root.hex(),
            "proof_sha256": [proof_hash(p + outer_path) for p in paths],
            "folded_root": [e.hex() for e in ends],
            "verified": [e == root for e in ends],
        })

    left = leaves.select("tree", _super(height).alias("block"), "pos", "n", "digest", "presented", "doc_id").groupBy("tree", "block")
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return left.cogroup(outer.groupBy("tree", "block")).applyInPandas(join, schema)


def tiers_of(nodes: DataFrame, name: str, height: int) -> list[DataFrame]:
    """``nodes`` and the tiers above them, up to one node for each tree."""
    out = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        out.append(upper_tier(out[-1], name, height))
        largest = -(-largest // FAN**height)
    return out


def manifest(leaves: DataFrame, height: int = LEVELS) -> DataFrame:
    """``leaves``: tree (string), doc_id (long), digest (32 bytes), presented (the digest that is folded). ``height``: levels of a superblock.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.
    """
    leaves = stored(leaves.withColumn("place", F.monotonically_increasing_id()), "leaves")
    placed = stored(positions(leaves, ["doc_id", "digest"], "ordered-leaves"), "placed-leaves")
    tiers = tiers_of(placed, "tier", height)
    tops = tiers[-1].select("tree", "digest")
    langs = tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest", F.lit(0).alias("place"))
    langs = stored(positions(langs, ["lang"], "ordered-langs"), "placed-langs")
    lang_tiers = tiers_of(langs, "lang-tier", height)
    # Downwards: a superblock's outer nodes are the path of its root.
    outer = lang_tiers[-1].select("tree", F.col("pos").alias("block"), F.lit(b"").alias("path"), F.col("digest").alias("top"), F.col("digest").alias("root"))
    for tier in lang_tiers[-2::-1]:
        outer = with_paths(tier, outer, height).withColumnRenamed("pos", "block")
    named = langs.select(F.col("pos").alias("block"), F.col("lang").alias("tree"), F.col("digest").alias("top"))
    outer = named.join(outer.select("block", "path", "root"), "block").select("tree", F.lit(0).cast("long").alias("block"), "path", "top", "root")
    for tier in tiers[-2:0:-1]:
        outer = with_paths(tier, outer, height).withColumnRenamed("pos", "block")
    return proofs(placed, outer, height)


def tampered(doc_id: Column) -> Column:
    """Whether the row with this id is tampered with: 3 divides the crc32 of its decimal form."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``documents`` rows, and the leaf that each row presents: of the tampered row where ``tampered``."""
    c = {f: F.col(f"`{f}`") for f in FIELDS}
    own = leaf([c[f] for f in FIELDS])
    forged = leaf([c[f] if f != "text" else F.translate(c[f], _UPPER, _LOWER) for f in FIELDS])
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), c["lang"].cast("string")), F.lit("0")).alias("tree"),
        c["doc_id"].cast("long").alias("doc_id"),
        own.alias("digest"),
        F.when(tampered(c["doc_id"]), forged).otherwise(own).alias("presented"),
    )


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return manifest(document_leaves(table(spark, sf_dir, "documents")))


def sql(levels: int = 14, lang_levels: int = 6) -> str:
    """The same in SQL, level by level, for trees of up to ``FAN ** levels`` leaves."""

    def part(value: str) -> str:
        return f"coalesce(strlen({value}) || ':' || {value}, '-')"

    def row(text: str) -> str:
        return "sha256(" + " || ".join([part("CAST(doc_id AS VARCHAR)"), part("source"), part("lang"), part("CAST(n_chars AS VARCHAR)"), part(text)]) + ")"

    step = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
    table_ = "SELECT i, i AS c FROM range(256) r(i)"
    for _ in range(8):
        table_ = f"SELECT i, {step} AS c FROM ({table_})"
    out = [
        f"crcs AS (SELECT list(c ORDER BY i) AS t FROM ({table_}))",
        "marked AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM documents, crcs)",
        f"rows_ AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {row('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {row(f'''translate(text, '{_UPPER}', '{_LOWER}')''')} ELSE {row('text')} END AS f FROM marked)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows_)",
        "a0 AS (SELECT tree, pos, n, leaf AS d FROM placed)",
    ]

    def climb(p: str, n_levels: int) -> None:
        for i in range(n_levels):
            out.append(f"{p}{i + 1} AS (SELECT tree, pos // {FAN} AS pos, CASE WHEN any_value(n) > 1 THEN (any_value(n) + {FAN - 1}) // {FAN} ELSE 1 END AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {p}{i} GROUP BY tree, pos // {FAN})")
            out.append(f"{p}s{i} AS (SELECT x.tree, x.pos, x.n, coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS lt, coalesce(string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS rt FROM {p}{i} x JOIN {p}{i} y ON x.tree = y.tree AND x.pos // {FAN} = y.pos // {FAN} GROUP BY x.tree, x.pos, x.n)")

    climb("a", levels)
    out.append(f"b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, d, tree AS lang FROM a{levels})")
    climb("b", lang_levels)
    out.append(f"f0 AS (SELECT p.doc_id, p.leaf, p.tree, p.pos, p.f, '' AS proof, b0.pos AS lp, b0.d AS subroot, (SELECT d FROM b{lang_levels}) AS root FROM placed p JOIN b0 ON b0.lang = p.tree)")
    for i in range(levels + lang_levels):
        own, k = ("a", i) if i < levels else ("b", i - levels)
        on = f"s.tree = f.tree AND s.pos = f.pos // {FAN**k}" if own == "a" else f"s.pos = f.lp // {FAN**k}"
        out.append(f"f{i + 1} AS (SELECT f.* REPLACE (CASE WHEN s.n > 1 THEN sha256(s.lt || f.f || s.rt) ELSE f.f END AS f, CASE WHEN s.n > 1 THEN f.proof || s.lt || s.rt ELSE f.proof END AS proof) FROM f{i} f JOIN {own}s{k} s ON {on})")
    last = f"f{levels + lang_levels}"
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM {last}"
