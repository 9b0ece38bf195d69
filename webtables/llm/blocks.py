"""Blocks of texts, and the sorted keys that they send to partitions of all keys and back.

A block is a bounded run of rows as one compressed row, so that a later step can meet the same texts with what
other blocks had to say about them, without moving each row on its own. Keys are sorted unsigned 64-bit
integers; what travels are their gaps in byte planes, compressed: about as many bits a key as the gaps have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODEC = "zstd"
SCHEMA = "block long, n_bytes long, data binary"


def encoded(keys: np.ndarray) -> bytes:
    """Sorted keys as bytes: their number, and the compressed byte planes of their gaps."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(keys).to_bytes(7, "little") + bytes([width]) + packed_bytes(planes.tobytes())


def number_of(data: bytes) -> int:
    """How many keys ``data`` holds."""
    return int.from_bytes(data[:7], "little")


def decoded(data: bytes) -> np.ndarray:
    n, width = number_of(data), data[7]
    planes = np.frombuffer(unpacked_bytes(data[8:], n * width), np.uint8).reshape(width, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = planes.T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def ranges(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Where the sorted ``keys`` of each of ``parts`` equal ranges begin, and their number."""
    bounds = np.array([-(-(p << bits) // parts) for p in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


def packed_bytes(data: bytes) -> bytes:
    return pa.Codec(_CODEC).compress(data, asbytes=True) if data else b""


def unpacked_bytes(data: bytes, size: int) -> bytes:
    return pa.Codec(_CODEC).decompress(data, size, asbytes=True) if size else b""


def blocked(rows: DataFrame, block_bytes: int) -> DataFrame:
    """``rows`` of columns of fixed size and one last binary column as ``block, n_bytes, data``.

    A block takes consecutive rows of one partition, until their last column has ``block_bytes`` bytes; a longer
    value is a block of its own. Blocks are numbered by partition and place, so in the order of the rows.
    """
    out_schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal block, held, size
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as w:
                for b in held:
                    w.write_batch(b)
            row = pa.RecordBatch.from_arrays([pa.array([block]), pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], schema=out_schema)
            block, held, size = block + 1, [], 0
            return row

        for b in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(b.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = 0
            for k, n in enumerate(sizes):
                size += int(n)
                if size >= block_bytes:
                    held.append(b.slice(first, k + 1 - first))
                    first = k + 1
                    yield flush()
            if first < b.num_rows:
                held.append(b.slice(first))
        if held:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)


def rows_of(data: bytes) -> Iterator[pa.RecordBatch]:
    """The rows of a block again."""
    with pa.ipc.open_stream(data) as reader:
        yield from reader


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


#: Bytes of answers that are sent to every executor at most.
BROADCAST_BYTES = 32 << 20


def met(blocks: DataFrame, answers: DataFrame, source: DataFrame, row_bytes: int = 0) -> DataFrame:
    """``blocks`` joined with their ``answers``, one row for each block that has any.

    ``source``: the stored table that the answers are gathered from. Its bytes are added up; up to ``BROADCAST_BYTES`` they go
    to the blocks, beyond that both sides are dealt by block.
    """
    binary = [f.name for f in source.schema if f.dataType.simpleString() == "binary"]
    size = sum((F.length(c) for c in binary), F.lit(row_bytes or 16))
    total = source.agg(F.sum(size)).first()[0] or 0
    return blocks.join(F.broadcast(answers) if total <= BROADCAST_BYTES else answers, "block", "left")
