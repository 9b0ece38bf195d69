"""Collocations: phrases whose words meet more often than their parts would by chance.

1. Texts are put in blocks. A block names its phrases of 1 to ``WORDS`` words by 64 bits of their words and language, and
   sends each hash partition a summary: the sorted names of its phrases and how often each occurs in the block.
2. The summaries of a partition are merged as Misra and Gries have it: where there are more counters than the
   capacity, the next greatest count is taken off all and what is used up goes. The capacity exceeds the partition's mass
   divided by ``least``, so less than ``least`` is taken off any count, and every phrase that occurs ``least``
   times is left over. For the mass a count stops at ``least``, since one block then proves the phrase
   frequent: a very common phrase is no more of a partition than a few others.
3. A second pass over the same summaries counts exactly, but only what is left over. Memory is that of the counters and of
   one block's names; the summaries themselves stay compressed, about six bytes a phrase. There are as many
   partitions as the mass asks for, so a partition does not grow with the table.
4. The first block that has a frequent phrase is told its name and count, and gives its text: one row for each phrase.
5. Scores, cuts, containment and ranks are joins and windows over the frequent phrases.

Names are the only thing that is not exact: n distinct phrases have an equal name by accident with a chance of
n * n / 2^65.

Defined cases: a null text is empty; a null language is ``und``; an empty table gives no rows; repeated rows count
each; a text of any length is cut into slices, between words, the last words of a slice going before the next one
without being counted; a word of any length is one word; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm.blocks import batch_of, blocked, decoded, encoded, met, number_of, packed_bytes, ranges, rows_of, unpacked_bytes
from webtables.llm.common import stored, text_table
from webtables.llm.shingles import mixed

#: Words of a phrase at most.
WORDS = 5
#: Bytes of text of a block, and of a slice that is worked on at a time.
BLOCK_BYTES, SLICE_BYTES = 4 << 20, 4 << 20
#: Mass of a hash partition on average at most: phrases of all blocks, each counted up to ``least`` times a block.
MASS = 1 << 26
#: Rows, and bytes of summaries, that a step gives out at a time.
OUT_ROWS, SENT_BYTES = 8192, 1 << 20
#: The bytes that end a piece, and those between words (fixed values).
ENDS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_TABLE = bytes(0x0A if b in ENDS else 0x20 if b in GAPS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLACE = np.random.default_rng(20250111).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Slice:
    """Words of some texts as numbers; 0 ends a piece. ``context``: leading words that are not counted."""

    def __init__(self, context: int = 0):
        self.context, self.bytes = context, 0
        self.numbers: dict[str, _Numbers] = {}
        self.words: list[tuple[str, bytes]] = [("", b"")]
        self.hashes: list[int] = [0]
        self.parts: list[np.ndarray] = []

    def add(self, lang: str, tokens: list[bytes]) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = _Numbers(self.words, self.hashes, lang)
        numbers = self.numbers[lang]
        part = np.fromiter((numbers[t] for t in tokens), np.int64, len(tokens))
        self.parts += [part[part >= 0], np.zeros(1, np.int64)]

    def text(self) -> np.ndarray:
        return np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)


class _Numbers(dict):
    """The numbers of the words of a language in a slice. It knows the slice's lists, not the slice: a slice goes as soon as it is done."""

    def __init__(self, words: list[tuple[str, bytes]], hashes: list[int], lang: str):
        super().__init__({b"": -1, b"\n": 0})
        self.words, self.hashes, self.lang, self.seed = words, hashes, lang, xxhash.xxh64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        self.words.append((self.lang, word))
        self.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        self[word] = n = len(self.words) - 1
        return n


def slices(texts: Iterator[tuple[str, bytes]], slice_bytes: int) -> Iterator[Slice]:
    """Texts (lang, bytes) in slices; a long one is cut between words, and goes on in slices of its own."""
    now = Slice()
    for lang, text in texts:
        text = text.translate(_TABLE)
        at, before = 0, []
        while at < len(text):
            end = min(len(text), at + slice_bytes)
            if end < len(text):
                gap = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
                if gap < 0:
                    later = [k for k in (text.find(b" ", end), text.find(b"\n", end)) if k >= 0]
                    gap = min(later, default=len(text) - 1)
                end = gap + 1
            if before or now.bytes + end - at > slice_bytes:
                yield now
                now = Slice(len(before))
            tokens = before + text[at:end].replace(b"\n", b" \n ").split(b" ")
            now.add(lang, tokens)
            now.bytes += end - at
            before = []
            if end < len(text):
                for t in reversed(tokens):
                    if t == b"\n" or len(before) == WORDS - 1:
                        break
                    if t:
                        before.insert(0, t)
            at = end
    yield now


def phrases(s: Slice) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per number of words: (words, places, names) of all phrases, one entry for each place."""
    w, hashes = s.text(), np.array(s.hashes, np.uint64)
    places = np.flatnonzero(w > 0)
    sums = np.zeros(len(places), np.uint64)
    for n in range(1, WORDS + 1):
        inside = places + n <= len(w)
        places, sums = places[inside], sums[inside]
        last = w[places + n - 1]
        places, sums = places[last > 0], sums[last > 0] + hashes[last[last > 0]] * _PLACE[n - 1]
        yield n, places, mixed(sums + np.uint64(n))


def names_of(s: Slice) -> np.ndarray:
    """The names of all phrases of a slice that are counted, sorted, one for each place."""
    out, size = np.empty(WORDS * sum(len(p) for p in s.parts), np.uint64), 0
    for n, places, names in phrases(s):
        names = names[places + n > s.context]
        out[size : size + len(names)] = names
        size += len(names)
    out = out[:size]
    out.sort()
    return out


def among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``keys`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


class Summary:
    """A mergeable Misra-Gries summary of ``capacity`` counters."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.capacity + (1 << 18):
            self.settle()

    def settle(self) -> None:
        keys, counts = added(
            np.concatenate([self.keys, *[k for k, _ in self.waiting]]),
            np.concatenate([self.counts, *[c for _, c in self.waiting]]),
        )
        self.waiting, self.size = [], 0
        if len(keys) > self.capacity:
            least = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            keys, counts = keys[counts > least], counts[counts > least] - least
            self.taken += least
        self.keys, self.counts = keys, counts

    def frequent(self, least: int) -> np.ndarray:
        """The keys that may have a count of ``least``: all that do are among them while ``taken`` is below ``least``."""
        self.settle()
        return self.keys[self.counts + self.taken >= least]


def _texts(data: bytes) -> Iterator[tuple[str, bytes]]:
    for rows in rows_of(data):
        for lang, text in zip(rows.column(0), rows.column(1)):
            yield lang.as_py(), text.as_py()


def summaries(blocks: DataFrame, parts: int, slice_bytes: int) -> DataFrame:
    """Each block's summaries, one for a slice and hash partition: ``part, block, slice, keys, counts``."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("slice", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                for no, s in enumerate(slices(_texts(data.as_py()), slice_bytes)):
                    names = names_of(s)
                    del s  # the words go before what is sent is made
                    at, rows, size = ranges(names, 64, parts), [], 0
                    for p, (i, j) in enumerate(zip(at[:-1], at[1:])):
                        if j > i:
                            edge = np.flatnonzero(np.concatenate([[True], names[i + 1 : j] != names[i : j - 1]]))
                            counts = np.diff(edge, append=j - i).astype("<u4")
                            rows.append((p, block, no, encoded(names[i:j][edge]), packed_bytes(counts.tobytes())))
                            size += len(rows[-1][3]) + len(rows[-1][4])
                            if size >= SENT_BYTES:
                                yield batch_of(schema, rows)
                                rows, size = [], 0
                    yield batch_of(schema, rows)

    return blocks.select("block", "data").mapInArrow(run, "part int, block long, slice int, keys binary, counts binary")


def frequent(sent: DataFrame, least: int) -> DataFrame:
    """``block, slice, part, keys, counts``: the frequent names and their exact counts, each with the first slice that has it."""

    schema = pa.schema([("block", pa.int64()), ("slice", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def merge(group: pa.Table) -> pa.Table:
        order = pa.compute.sort_indices(group, [("block", "ascending"), ("slice", "ascending")]).to_pylist()
        keys_, counts_ = group["keys"], group["counts"]

        def counts_of(k: int) -> np.ndarray:
            n = number_of(keys_[k].as_py())
            return np.frombuffer(unpacked_bytes(counts_[k].as_py(), 4 * n), "<u4").astype(np.int64)

        summary = Summary(sum(int(np.minimum(counts_of(k), least).sum()) for k in order) // least + 1)
        for k in order:
            summary.merge(decoded(keys_[k].as_py()), np.minimum(counts_of(k), least))
        left = summary.frequent(least)
        total, first = np.zeros(len(left), np.int64), np.full(len(left), -1, np.int64)
        for no, k in enumerate(order):
            keys = decoded(keys_[k].as_py())
            here = among(keys, left)
            at = np.searchsorted(left, keys[here])
            total[at] += counts_of(k)[here]
            first[at[first[at] < 0]] = no
        found = np.flatnonzero(total >= least)
        found = found[np.argsort(first[found], kind="stable")]
        edge = np.flatnonzero(np.diff(first[found], prepend=-1))
        out = []
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(found)]):
            mine, k = found[i:j], order[first[found[i]]]
            out.append((*(group[c][k].as_py() for c in ("block", "slice", "part")), encoded(left[mine]), packed_bytes(total[mine].astype("<i8").tobytes())))
        return pa.Table.from_batches([batch_of(schema, out)])

    return sent.groupBy("part").applyInArrow(merge, "block long, slice int, part int, keys binary, counts binary")


def texts(blocks: DataFrame, replies: DataFrame, slice_bytes: int) -> DataFrame:
    """``lang, phrase, words, n`` of the frequent phrases; with ``words`` 0 the words of each language in a slice."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            for data, reply in zip(b.column(0), b.column(1)):
                asked: dict[int, list[tuple]] = {}
                for r in reply.as_py() or ():
                    keys = decoded(r["keys"])
                    asked.setdefault(r["slice"], []).append((r["part"], keys, np.frombuffer(unpacked_bytes(r["counts"], 8 * len(keys)), "<i8")))
                for no, s in enumerate(slices(_texts(data.as_py()), slice_bytes)):
                    parts = sorted(asked.pop(no, []), key=lambda x: x[0])
                    rows = words_of_slice(s)
                    if parts:
                        rows = chain(rows, phrases_of(s, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])))
                    while some := list(islice(rows, OUT_ROWS)):
                        yield batch_of(schema, some)

    each = replies.groupBy("block").agg(F.collect_list(F.struct("slice", "part", "keys", "counts")).alias("reply"))
    return met(blocks, each, replies).select("data", "reply").mapInArrow(run, "lang string, phrase string, words int, n long")


def words_of_slice(s: Slice) -> Iterator[tuple]:
    langs, which = np.unique(np.array([lang for lang, _ in s.words], object), return_inverse=True)
    own = s.text()[s.context :]
    for lang, n in zip(langs, np.bincount(which[own[own > 0]], minlength=len(langs))):
        if n:
            yield lang, "", 0, int(n)


def phrases_of(s: Slice, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
    """The texts of the names ``keys``, sorted, with their counts."""
    w = s.text()
    for n, places, names in phrases(s):
        here = among(names, keys)
        some, first = np.unique(names[here], return_index=True)
        for at, c in zip(places[here][first], counts[np.searchsorted(keys, some)]):
            words = [s.words[k] for k in w[at : at + n]]
            yield words[0][0], b" ".join(t for _, t in words).decode("utf-8", "replace"), n, int(c)


def frequent_phrases(docs: DataFrame, least: int, text: str = "text", lang: str = "lang", block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES, mass: int = MASS) -> DataFrame:
    """``lang, phrase, words, n`` of all phrases of 1 to ``WORDS`` words that occur ``least`` times in a language.

    A row with ``words`` 0 has the number of all words of the language.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    blocks = stored(blocked(rows, block_bytes), "blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    most = max(1, WORDS * (n_bytes // 2 + 1))  # a word and what follows it are two bytes at least
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-most // mass), min(spread, -(-most // (1 << 20))))
    replies = stored(frequent(summaries(blocks, parts, slice_bytes), least), "frequent")
    # A phrase has one row; the words of a language are added up.
    return texts(blocks, replies, slice_bytes).groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang", **sizes: int) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``, as the module says."""
    known = stored(frequent_phrases(docs, least, text, lang, **sizes), "phrases")
    totals = known.where("words = 0").select("lang", F.col("n").alias("total"))
    parts = known.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    phrases_ = known.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    within = phrases_.where("words > 2").select(
        "lang", "a",
        F.explode(F.array(
            F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)"),
            F.expr("substring_index(phrase, ' ', words - 1)"),
        )).alias("phrase"),
    )
    # A longer candidate as frequent as a phrase has one of just one word more between them, as frequent as both.
    kept = phrases_.join(within, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', k)").alias("head"))
    cuts = cuts.select("*", F.expr("substring(phrase, length(head) + 2)").alias("tail"))
    cuts = cuts.join(parts.toDF("lang", "head", "l"), ["lang", "head"]).join(parts.toDF("lang", "tail", "r"), ["lang", "tail"]).join(totals, "lang")
    big = {c: F.col(c).cast("decimal(19,0)").cast("decimal(38,0)") for c in ("a", "total", "l", "r")}
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", "total", (F.lit(1000).cast("decimal(38,0)") * big["a"] * big["total"]).alias("over"), (big["l"] * big["r"]).alias("under"))
    scored = cuts.select("lang", "phrase", "a", F.col("total").alias("n"), F.struct(F.expr("over div under").alias("score"), "k", "l", "r").alias("cut"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    flat = lowest.select("lang", "phrase", "a", "n", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_misra_gries_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(text_table(spark, sf_dir, "documents"))


def sql(least: int = 100, top: int = 2000) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM pieces
), totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, w, i, unnest(range(1, {WORDS + 1})) AS words FROM places),
f AS (
  SELECT lang, array_to_string(w[i : i + words - 1], ' ') AS phrase, words, count(*) AS f
  FROM grams WHERE i + words - 1 <= len(w) GROUP BY ALL HAVING count(*) >= {least}
), candidates AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
inner_ AS (
  SELECT DISTINCT lang, array_to_string(w[i : j], ' ') AS phrase, a FROM (
    SELECT lang, w, a, words, i, unnest(range(i + 1, CAST(words AS BIGINT) + 1)) AS j FROM (SELECT *, unnest(range(1, words)) AS i FROM candidates)
  ) WHERE j - i + 1 < words
), kept AS (SELECT c.* FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
cuts AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, t.n,
    CAST((1000::HUGEINT * k.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM kept) k
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 : k.words], ' ')
  JOIN totals t ON t.lang = k.lang
), lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {top}"""
