"""Cost-balanced packing of token sequences.

The cost of a sequence is estimated as the sum over its pieces of ``LINEAR * n + QUADRATIC * n * n``
(attention is within a piece). A document's full sequences of ``capacity`` ids are cut off first; a
longer document yields them as it is read. What remains of the documents is packed in windows: in
descending length, each remainder goes to the cheapest sequence with room for it. Where none has
room, the rest is cut: it fills the cheapest sequences that have any room. A window opens exactly as
many sequences as its ids need, so all but one of them are full.

A window is a bounded run of rows of one partition (``window_ids`` ids), so nothing is shuffled and a
task holds one window at most, however the rows are dealt. A task's rows do not depend on other tasks:
a lost executor's tasks are run again and give sequences of their own numbers.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each on its own;
a null id is carried as null; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CAPACITY = 1024
#: Cost model: per id, and per pair of ids of a piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 512
#: Ids of remainders that are packed together.
WINDOW_IDS = 1 << 20
#: Rows given out at a time.
OUT_ROWS = 4096
END_ID = 0

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: np.ndarray, capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Yield (item, from, length, sequence, offset) for items no longer than ``capacity``.

    Ties: the longer item first, then the earlier one; the cheaper sequence, then the earlier one.
    """
    total = int(lengths.sum())
    rooms = np.full(-(-total // capacity), capacity, np.int64)
    if total % capacity:
        rooms[-1] = total % capacity
    size, costs = rooms.copy(), np.zeros(len(rooms))
    late: list[tuple[int, int, int]] = []
    for item in np.argsort(-lengths, kind="stable"):
        n = int(lengths[item])
        best = int(np.argmin(np.where(rooms >= n, costs, np.inf)))
        if rooms[best] >= n:
            yield int(item), 0, n, best, int(size[best] - rooms[best])
            rooms[best] -= n
            costs[best] += cost(n)
        else:
            late.append((int(item), 0, n))
    open_ = [int(s) for s in np.argsort(costs, kind="stable") if rooms[s] > 0]
    for item, at, n in late:
        while n:
            s = open_[0]
            take = min(n, int(rooms[s]))
            yield item, at, take, s, int(size[s] - rooms[s])
            rooms[s] -= take
            at, n = at + take, n - take
            if rooms[s] == 0:
                open_.pop(0)


class _Packer:
    """Packs the documents of one partition, one window at a time."""

    def __init__(self, partition: int, capacity: int, window_ids: int):
        self.capacity, self.window_ids = capacity, window_ids
        self.next_sequence = partition << 40
        self.held: list[tuple] = []
        self.held_ids = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        n, step = len(ids) // 4, 4 * self.capacity
        full = n // self.capacity
        for k in range(full):
            yield doc_id, k * self.capacity, self.capacity, ids[k * step : (k + 1) * step], n, self.next_sequence, 0
            self.next_sequence += 1
        if n % self.capacity:
            self.held.append((doc_id, full * self.capacity, ids[full * step :], n))
            self.held_ids += n % self.capacity
        if self.held_ids >= self.window_ids:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.held:
            lengths = np.array([len(ids) // 4 for _, _, ids, _ in self.held], np.int64)
            last = 0
            for item, at, n, sequence, offset in assign(lengths, self.capacity):
                doc_id, start, ids, total = self.held[item]
                yield doc_id, start + at, n, ids[4 * at : 4 * (at + n)], total, self.next_sequence + sequence, offset
                last = max(last, sequence)
            self.next_sequence += last + 1
        self.held, self.held_ids = [], 0


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, window_ids: int = WINDOW_IDS, digest: bool = False) -> DataFrame:
    """Pieces of sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` holds little-endian unsigned 32-bit ids. ``digest``: ``ids_crc32`` (long) instead of ``ids``.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    if digest:
        fields[3] = ("ids_crc32", pa.int64())
    out_schema = pa.schema(fields)
    schema = SCHEMA.replace("ids binary", "ids_crc32 long") if digest else SCHEMA
    end = END_ID.to_bytes(4, "little")

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out_schema)], schema=out_schema)

    def run(batches):
        from pyspark import TaskContext

        from webtables.llm.bpe import bpe

        encoder, packer = bpe(tokenizer), _Packer(TaskContext.get().partitionId(), capacity, window_ids)
        rows: list[tuple] = []

        def pieces():
            for b in batches:
                for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                    yield from packer.add(d, encoder.ids(t.as_py() or "") + end)
            yield from packer.close()

        for p in pieces():
            rows.append((*p[:3], zlib.crc32(p[3]), *p[4:]) if digest else p)
            if len(rows) >= OUT_ROWS:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"CAST(`{text}` AS STRING) AS text").mapInArrow(run, schema)


def op6_cost_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)
