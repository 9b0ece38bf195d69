"""Removal of repeated passages: every byte in a string of ``LENGTH`` bytes that also starts earlier.

Suffixes are compared up to ``LENGTH`` bytes, and only those that a cover sample lets tie are sorted at all:

1. Texts are put in blocks. Rows with the text of an earlier row are found by their digests; a repeated text is removed
   whole and takes no further part.
2. Cover samples: the places whose offset in the text is, modulo ``PERIOD``, in the difference cover ``COVER``.
   Whatever two offsets are, some step below ``PERIOD`` from both leads to a sample; so two equal strings of ``LENGTH`` bytes
   hold two samples, equally far in, with the same ``SAMPLE`` = LENGTH - PERIOD + 1 bytes. Blocks send fingerprints of
   the sample strings to hash partitions and learn which of theirs occur twice or more: their rank among
   all samples is a tie. This is computed once, before any suffix is sorted.
3. A suffix without a tied sample within its first ``PERIOD`` bytes differs from all others within ``LENGTH`` bytes. The
   others are named by 64 bits of their ``LENGTH`` bytes and dealt to buckets, ranges of names; a block sends each name
   once, with its first document. A bucket is sorted at a time, by name, document and place: all but the first of
   a name start earlier elsewhere. Buckets hold a bounded number of suffixes: there are as many as the bytes ask for.
4. Blocks are answered by one bit for each name they sent; they mark the bytes, and give out the spans and what is left.

So a suffix is compared by its cover samples first, then by name: never byte by byte, and never all at once. A bit in
vain at step 2 (fingerprints have few bits) only lets more suffixes through; at step 3, n distinct strings have an
equal name by accident with a chance of n * n / 2^65.

The first of several rows of one id is the one with the least hash of its text, then the first in its block.

Defined cases: a null or empty text has no bytes; a text shorter than ``LENGTH`` stays; repeated rows: one stays, the
others go; a row without id comes before all others; an empty table gives no rows; a long text is worked on in
slices, each with the ``LENGTH`` - 1 bytes after it; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm.blocks import batch_of, blocked, decoded, encoded, met, packed_bytes, ranges, rows_of, unpacked_bytes
from webtables.llm.common import stored, text_table
from webtables.llm.shingles import mixed

#: Bytes of a repeated string.
LENGTH = 100
#: A perfect difference set: every difference modulo ``PERIOD`` occurs (fixed values).
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
SAMPLE = LENGTH - PERIOD + 1
#: Bytes of text of a block, and of a slice that is worked on at a time.
BLOCK_BYTES, SLICE_BYTES = 2 << 20, 2 << 20
#: Sample strings, and bytes, for each hash partition.
SAMPLES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Bits of a sample's fingerprint beyond those of the number of samples.
SPARE_BITS = 9
NO_ID = -(2**63)
_BASE = 0xB5026F5AA96619E9
_UNBASE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(20250203).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NONE = np.zeros(0, bool)  # the answer to a slice that sent nothing
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers at least; the longest list asked for is kept."""
    if base not in _powers_of or len(_powers_of[base]) < n:
        out = np.full(max(n, 1 << 12), base, np.uint64)
        out[0] = 1
        _powers_of[base] = np.multiply.accumulate(out)
    return _powers_of[base]


class Text:
    """A row of a block: id, number in the block, bytes, and whether an earlier row has the same text."""

    __slots__ = ("doc_id", "no", "data", "copy", "tie")

    def __init__(self, doc_id: int | None, no: int, data: bytes, copy: bool = False):
        self.doc_id, self.no, self.data, self.copy = doc_id, no, data, copy
        self.tie = xxhash.xxh32_intdigest(data)

    @property
    def order(self) -> tuple[int, int, int]:
        return (NO_ID if self.doc_id is None else self.doc_id), self.tie, self.no


class Slice:
    """Parts of texts, in order, that hold the strings starting in them: (text, first, end) and ``LENGTH`` - 1 bytes more."""

    def __init__(self, parts: list[tuple[Text, int, int]]):
        self.parts = parts
        pieces = [t.data[a : b + LENGTH - 1] for t, a, b in parts]
        self.sizes = [len(p) for p in pieces]
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(self.bytes)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.bytes] * _powers(_BASE, n)[:n], out=self._sums[1:])
        self._down = _powers(_UNBASE, n)
        pattern = np.zeros(PERIOD, bool)
        pattern[list(COVER)] = True
        pattern = np.tile(pattern, -(-max(self.sizes, default=0) // PERIOD) + 1)
        self.sampled, self.whole = np.zeros(n, bool), np.zeros(n, bool)
        self.own = np.ones(n, bool)
        for (text, a, b), at, size in zip(parts, self.starts, self.sizes):
            inside = max(0, size - SAMPLE + 1)
            self.sampled[at : at + inside] = pattern[a % PERIOD : a % PERIOD + inside]
            self.whole[at : at + max(0, min(b - a, size - LENGTH + 1))] = True
            self.own[at + b - a : at + size] = False

    def names(self, places: np.ndarray, length: int) -> np.ndarray:
        """A hash of the ``length`` bytes at each place."""
        return mixed((self._sums[places + length] - self._sums[places]) * self._down[places])

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, which fingerprint each has, sorted fingerprints, how often each starts here: 0, 1 or 2 for more)."""
        places = np.flatnonzero(self.sampled)
        keys, first, which = np.unique(self.names(places, SAMPLE) >> np.uint64(64 - bits), return_index=True, return_inverse=True)
        return places, which, keys, np.minimum(np.bincount(which, self.own[places], len(keys)), 2).astype(np.uint8)

    def suffixes(self, places: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(places, which name each has, sorted names, the first place of each) of the suffixes with a tied sample."""
        ties = np.zeros(len(self.bytes) + PERIOD + 1, np.int32)
        ties[places[tied] + 1] = 1
        np.cumsum(ties, out=ties)
        candidates = np.flatnonzero(self.whole)
        candidates = candidates[ties[candidates + PERIOD] > ties[candidates]]
        names, first, which = np.unique(self.names(candidates, LENGTH), return_index=True, return_inverse=True)
        return candidates, which, names, candidates[first]

    def part_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, "right") - 1


def texts_of(data: bytes, copies) -> list[Text]:
    gone, out = set(copies or ()), []
    for rows in rows_of(data):
        for doc_id, text in zip(rows.column(0), rows.column(1)):
            out.append(Text(doc_id.as_py(), len(out), text.as_py(), len(out) in gone))
    return out


def slices(texts: list[Text], slice_bytes: int) -> Iterator[Slice]:
    """The texts that can hold repeated strings, ascending; a slice is some of them, or a part of a longer one."""
    parts, size = [], 0
    for t in sorted((t for t in texts if not t.copy and len(t.data) >= LENGTH), key=lambda t: t.order):
        for a in range(0, len(t.data), slice_bytes):
            b = min(len(t.data), a + slice_bytes)
            if parts and size + b - a > slice_bytes:
                yield Slice(parts)
                parts, size = [], 0
            parts.append((t, a, b))
            size += b - a
    if parts:
        yield Slice(parts)


def sent_samples(blocks: DataFrame, bits: int, parts: int, slice_bytes: int) -> DataFrame:
    """``part, block, slice, n, keys, counts``: sorted fingerprints of the samples of each slice."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("slice", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        for b in batches:
            for block, data, copies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                for no, s in enumerate(slices(texts_of(data.as_py(), copies), slice_bytes)):
                    _, _, keys, counts = s.samples(bits)
                    at = ranges(keys, bits, parts)
                    yield batch_of(schema, [(p, block, no, j - i, encoded(keys[i:j]), packed_bytes(counts[i:j].tobytes())) for p, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i])

    return blocks.select("block", "data", "copies").mapInArrow(run, "part int, block long, slice int, n int, keys binary, counts binary")


def tied_samples(sent: DataFrame) -> DataFrame:
    """``block, slice, part, n, bits``: which fingerprints of each slice occur twice or more."""

    def tie(group: pd.DataFrame) -> pd.DataFrame:
        keys = [decoded(k) for k in group["keys"]]
        counts = [np.frombuffer(unpacked_bytes(c, len(k)), np.uint8) for c, k in zip(group["counts"], keys)]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        tied = (np.bincount(which, np.concatenate(counts)) > 1)[which]
        return _answers(group, tied)

    return sent.groupBy("part").applyInPandas(tie, ANSWER)


ANSWER = "block long, slice int, part int, n int, bits binary"


def _answers(group: pd.DataFrame, flags: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(group["n"].to_numpy())
    bits = [packed_bytes(np.packbits(flags[e - n : e]).tobytes()) for n, e in zip(group["n"], ends)]
    return pd.DataFrame({"block": group["block"], "slice": group["slice"], "part": group["part"], "n": group["n"], "bits": bits})


def _flags(replies: list[dict] | None) -> dict[int, np.ndarray]:
    """Per slice, one flag for each key it sent, in their order."""
    per: dict[int, list] = {}
    for r in replies or ():
        raw = np.frombuffer(unpacked_bytes(r["bits"], -(-r["n"] // 8)), np.uint8)
        per.setdefault(r["slice"], []).append((r["part"], np.unpackbits(raw, count=r["n"]).astype(bool)))
    return {s: np.concatenate([f for _, f in sorted(rows, key=lambda r: r[0])]) for s, rows in per.items()}


def sent_suffixes(blocks: DataFrame, bits: int, parts: int, slice_bytes: int) -> DataFrame:
    """``part, block, slice, n, keys, of, ids, ties``: sorted names, and of each the first document (``of``: its number in ``ids``)."""
    names = ("part", "block", "slice", "n", "keys", "of", "ids", "ties")
    schema = pa.schema(list(zip(names, [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 4)))

    def run(batches):
        for b in batches:
            for block, data, copies, replies in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3)):
                tied = _flags(replies.as_py())
                for no, s in enumerate(slices(texts_of(data.as_py(), copies), slice_bytes)):
                    places, which, keys, _ = s.samples(bits)
                    _, _, found, first = s.suffixes(places, tied.get(no, _NONE)[which])
                    owner = s.part_of(first)
                    at = ranges(found, 64, parts)
                    rows = []
                    for p, (i, j) in enumerate(zip(at[:-1], at[1:])):
                        if j > i:
                            used, of = np.unique(owner[i:j], return_inverse=True)
                            docs = [s.parts[u][0].order for u in used]
                            ids, ties = np.array([d[0] for d in docs], "<i8"), np.array([d[1] for d in docs], "<u4")
                            rows.append((p, block, no, j - i, encoded(found[i:j]), packed_bytes(of.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes()), ids.tobytes(), ties.tobytes()))
                    if rows:
                        yield batch_of(schema, rows)

    fields = "part int, block long, slice int, n int, keys binary, of binary, ids binary, ties binary"
    return blocks.select("block", "data", "copies", "samples").mapInArrow(run, fields)


def earlier_suffixes(sent: DataFrame) -> DataFrame:
    """Sort one bucket at a time; ``block, slice, part, n, bits``: which names of each slice start earlier elsewhere."""

    def sort(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "slice"])
        keys = [decoded(k) for k in group["keys"]]
        ids, ties = [], []
        for k, of, i, t in zip(keys, group["of"], group["ids"], group["ties"]):
            i, t = np.frombuffer(i, "<i8"), np.frombuffer(t, "<u4")
            width = 2 if len(i) < 1 << 16 else 4
            of = np.frombuffer(unpacked_bytes(of, width * len(k)), f"<u{width}")
            ids.append(i[of])
            ties.append(t[of])
        keys, ids, ties = np.concatenate(keys), np.concatenate(ids), np.concatenate(ties)
        order = np.lexsort((ties, ids, keys))  # stable: then by block and slice
        ordered = keys[order]
        again = np.zeros(len(keys), bool)
        again[order[1:]] = ordered[1:] == ordered[:-1]
        return _answers(group, again)

    return sent.groupBy("part").applyInPandas(sort, ANSWER)


def marked(blocks: DataFrame, bits: int, slice_bytes: int, with_text: bool) -> DataFrame:
    """The last step: bytes are marked, spans and what is left given out."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(_SPAN)), ("kept_sha256", pa.string())]
    if with_text:
        fields.append(("kept", pa.binary()))
    schema = pa.schema(fields)

    def result(text: Text, covered: np.ndarray | None) -> tuple:
        spans, left = [], text.data
        if text.copy and len(text.data) >= LENGTH:
            spans, left = [{"start": 0, "end": len(text.data)}], b""
        elif covered is not None and covered.any():
            edges = np.flatnonzero(np.diff(covered, prepend=False, append=False)).tolist()
            spans = [{"start": a, "end": e} for a, e in zip(edges[::2], edges[1::2])]
            left = np.frombuffer(text.data, np.uint8)[~covered].tobytes()
        row = (text.doc_id, len(text.data), len(text.data) - len(left), spans, hashlib.sha256(left).hexdigest())
        return (*row, left) if with_text else row

    def run(batches):
        for b in batches:
            for data, copies, samples, suffixes in zip(b.column(0), b.column(1).to_pylist(), b.column(2), b.column(3)):
                texts = texts_of(data.as_py(), copies)
                tied, earlier = _flags(samples.as_py()), _flags(suffixes.as_py())
                done, partial = set(), {}
                for no, s in enumerate(slices(texts, slice_bytes)):
                    rows = []
                    for text, a, covered in covered_parts(s, bits, tied.get(no, _NONE), earlier.get(no)):
                        if len(covered) == len(text.data):
                            rows.append(result(text, covered))
                            done.add(text.no)
                        else:
                            whole = partial.setdefault(text.no, np.zeros(len(text.data), bool))
                            whole[a : a + len(covered)] |= covered
                    if rows:
                        yield batch_of(schema, rows)
                yield batch_of(schema, [result(t, partial.get(t.no)) for t in texts if t.no not in done])

    names = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string" + (", kept binary" if with_text else "")
    return blocks.select("data", "copies", "samples", "suffixes").mapInArrow(run, names)


def covered_parts(s: Slice, bits: int, tied: np.ndarray, earlier: np.ndarray | None) -> Iterator[tuple[Text, int, np.ndarray]]:
    """(text, first byte, covered bytes) of each part of a slice."""
    places, which, _, _ = s.samples(bits)
    cover = np.zeros(len(s.bytes) + 1, np.int32)
    candidates, which, names, first = s.suffixes(places, tied[which])
    if len(names):
        starts = candidates[earlier[which] | (candidates != first[which])]
        cover[starts] += 1
        cover[starts + LENGTH] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    for (text, a, _), at, size in zip(s.parts, s.starts, s.sizes):
        yield text, a, covered[at : at + size]


def digests(blocks: DataFrame) -> DataFrame:
    """``block, no, doc_id, digest`` of every text of ``LENGTH`` bytes or more."""
    schema = pa.schema([("block", pa.int64()), ("no", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary())])

    def run(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1)):
                texts = texts_of(data.as_py(), ())
                yield batch_of(schema, [(block, t.no, t.doc_id, hashlib.sha256(t.data).digest()) for t in texts if len(t.data) >= LENGTH])

    return blocks.select("block", "data").mapInArrow(run, "block long, no long, doc_id long, digest binary")


def copies_of(blocks: DataFrame) -> DataFrame:
    """``block, no`` of the rows whose text an earlier row has: least id, then block and place."""
    rows = stored(digests(blocks).select("digest", F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "block", "no").alias("row")), "digests")
    first = rows.groupBy("digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "digest").where("row.block <> first.block OR row.no <> first.no").select("row.block", "row.no")


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = BLOCK_BYTES, slice_bytes: int = SLICE_BYTES, samples: int = SAMPLES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept_sha256`` (and ``kept``, the bytes left) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = stored(blocked(rows, block_bytes), "blocks")
    n_bytes = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    most = max(1, n_bytes // PERIOD * len(COVER))
    bits = min(63, most.bit_length() + SPARE_BITS)
    copies = stored(copies_of(blocks), "copies")
    blocks = met(blocks, copies.groupBy("block").agg(F.collect_list("no").alias("copies")), copies, 8)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def partitions(rows: int, each: int) -> int:
        return max(1, -(-rows // each), min(spread, -(-rows // (1 << 18))))

    answer = F.collect_list(F.struct("slice", "part", "n", "bits"))
    tied = stored(tied_samples(sent_samples(blocks, bits, partitions(most, samples), slice_bytes)), "tied")
    blocks = met(blocks, tied.groupBy("block").agg(answer.alias("samples")), tied)
    again = stored(earlier_suffixes(sent_suffixes(blocks, bits, partitions(n_bytes, bucket_bytes), slice_bytes)), "earlier")
    blocks = met(blocks, again.groupBy("block").agg(answer.alias("suffixes")), again)
    return marked(blocks, bits, slice_bytes, with_text)


def op12_cover_dedup(spark, sf_dir: str) -> DataFrame:
    found = repeats(text_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
