"""Token-id files: documents in ascending id order, ids in frames of a context-mixing range coder.

Documents are dealt by ranges of their ids and sorted; each partition encodes its texts, appends the
end id and writes frames of about ``FRAME_IDS`` ids (see ``id_coder``) and ``FRAME_DOCS`` documents at most, a longer document being cut over
several. Spark's writer commits the frames, one row each, as a table in the given folder: ``part,
frame`` (their order), ``start`` (ids before it in its part), ``n_ids``, ``docs`` (of each document its id, its
number in the part, its ids in this frame, and whether that is all of them) and ``data``. A task
that is run again writes its rows again; only committed ones are read.

Reading back, frames are decoded once, where they are read, and what is known of their pieces, without the ids, is written
to the shared folder. A part's first position is the sum of the parts before it: one number per part, of which
there are as many as shuffle partitions.

Defined cases: a null or empty text is its end id alone; rows are written each on its own, those of one
id in the order of their texts, rows without id first; an empty table writes no frames; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webtables.llm.common import scratch, stored
from webtables.llm.id_coder import decode, encode

#: Ids, and documents, of a frame at most.
FRAME_IDS, FRAME_DOCS = 8 << 20, 1 << 17
END_ID = 2

FRAMES = "part int, frame int, start long, n_ids long, docs array<struct<doc_id: long, no: long, n: long, whole: boolean>>, data binary"


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", frame_ids: int = FRAME_IDS) -> None:
    """Encode ``docs`` and write their frames to the folder ``path``."""
    end = np.array([END_ID], "<u4").tobytes()
    item = pa.struct([("doc_id", pa.int64()), ("no", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_())])
    schema = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(item)), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        from webtables.llm.bpe import bpe

        encoder, part = bpe(tokenizer), TaskContext.get().partitionId()
        frame, start, no = 0, 0, 0
        ids, index, held = [], [], 0

        def flush():
            nonlocal frame, start, ids, index, held
            data = encode(np.frombuffer(b"".join(ids), "<u4"))
            row = [[part], [frame], [start], [held], [index], [data]]
            out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)
            frame, start, ids, index, held = frame + 1, start + held, [], [], 0
            return out

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                left = encoder.ids(t.as_py() or "") + end
                size, no = len(left), no + 1
                while left:
                    take = left[: 4 * (frame_ids - held)]
                    left = left[len(take) :]
                    ids.append(take)
                    index.append({"doc_id": d, "no": no, "n": len(take) // 4, "whole": len(take) == size})
                    held += len(take) // 4
                    if held >= frame_ids or len(index) >= FRAME_DOCS:
                        yield flush()
        if held:
            yield flush()

    rows = docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FRAMES).write.parquet(path)


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """CRC-32 of the bytes of pieces given as (number of ids, CRC-32), in order."""
    crc = 0
    for n, own in pieces:
        zeros = bytes(4 * n)
        crc = own ^ zlib.crc32(zeros, crc) ^ zlib.crc32(zeros)
    return crc


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files in ``path``."""
    frames = spark.read.schema(FRAMES).parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = frames.join(F.broadcast(parts), "part").select("part", "frame", (F.col("base") + F.col("start")).alias("at"), "docs", "data")
    schema = pa.schema([("part", pa.int32()), ("start", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("whole", pa.bool_())])

    def run(batches):
        for b in batches:
            for part, at, docs, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
                index, raw = docs.as_py(), memoryview(decode(data.as_py()).astype("<u4").tobytes())
                n = np.array([d["n"] for d in index], np.int64)
                ends = np.cumsum(n)
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends, n)]
                columns = [[part] * len(index), at + ends - n, [d["doc_id"] for d in index], [d["no"] for d in index], n, crcs, [d["whole"] for d in index]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    pieces = placed.mapInArrow(run, "part int, start long, doc_id long, no long, n long, crc long, whole boolean")
    return _whole(stored(pieces, "pieces"))  # decoded once; whole and cut documents are read from here


def _whole(pieces: DataFrame) -> DataFrame:
    """Documents of one piece as they are; the others joined, each from its pieces in order."""

    @F.arrow_udf("long")
    def joined(groups: pa.Array) -> pa.Array:
        return pa.array([joined_crc([(p["n"], p["crc"]) for p in g]) for g in groups.to_pylist()], pa.int64())

    one = pieces.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = pieces.where("NOT whole").groupBy("part", "no").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("start").alias("start"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"),
    )
    return one.unionByName(cut.select("doc_id", "start", "n_tokens", joined("pieces").alias("ids_crc32")))


def op8_range_coded_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read(spark, path)
