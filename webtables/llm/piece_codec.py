"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all pieces. Run over a word it reports, at each position, every piece that ends
there (its own and those its output links lead to); each relaxes the best score at that position. A
character without a piece is its bytes. The model is that of ``unigram``; the segmentation is the best
of that model, and decoding gives the text back exactly. The space letter U+2581 itself, where a text
holds it, is written as bytes, so it is not taken for a space.

Defined cases: a null text is an empty one; an empty text has no ids; rows are encoded each on its own;
a null id is carried; an empty table gives an empty result; ids outside the vocabulary decode to an
error; other columns are not read.
"""

from __future__ import annotations

from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webtables.llm.bpe import _Memory
from webtables.llm.common import text_table
from webtables.llm.unigram import SPACE, Unigram, unigram, words_of


class Codec:
    def __init__(self, model: Unigram):
        import ahocorasick

        self.model = model
        self.automaton = ahocorasick.Automaton()
        for piece, (i, score) in model.pieces.items():
            self.automaton.add_word(piece, (i, len(piece), score))
        self.automaton.make_automaton()
        self.words = _Memory(self._word)

    def viterbi(self, word: str) -> list[int]:
        """Best ids of ``SPACE + word``; a space letter inside ``word`` is a character without a piece."""
        first, *rest = word.split(SPACE)
        ids = self._best(SPACE + first)
        for part in rest:
            ids += self.model.bytes_of(SPACE) + self._best(part)
        return ids

    def _best(self, text: str) -> list[int]:
        size = len(text)
        scores: list[int | None] = [0] + [None] * size
        pieces, back = [0] * (size + 1), [(0, 0)] * (size + 1)
        at = 0  # positions up to here are reached

        def fill(to: int) -> None:
            """Give characters without a piece their bytes, so that ``to`` is reached."""
            nonlocal at
            while at < to:
                at += 1
                if scores[at] is None:
                    score, n = self.model.byte_cost(text[at - 1])
                    scores[at], pieces[at], back[at] = scores[at - 1] + score, pieces[at - 1] + n, (-1, at - 1)

        for end, (i, length, score) in self.automaton.iter(text):
            end += 1
            fill(end - 1)
            start = end - length
            score += scores[start]
            if scores[end] is None or score > scores[end] or score == scores[end] and (pieces[start] + 1, start) < (pieces[end], back[end][1]):
                scores[end], pieces[end], back[end] = score, pieces[start] + 1, (i, start)
        fill(size)
        ids: list[int] = []
        while size:
            i, start = back[size]
            ids.extend(reversed(self.model.bytes_of(text[start])) if i < 0 else (i,))
            size = start
        ids.reverse()
        return ids

    def _word(self, word: str) -> bytes:
        return array("I", self.viterbi(word)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.words.__getitem__, words_of(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.model.raw.__getitem__, array("I", ids))).decode("utf-8", "surrogatepass")[1:]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(unigram(path))


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, ids`` (binary, little-endian unsigned 32-bit ids)."""

    def run(batches):
        c = codec(model_file)
        for b in batches:
            ids = [c.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary())], names=["doc_id", "text", "ids"])

    rows = docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"coalesce(CAST(`{text}` AS STRING), '') AS text")
    return rows.mapInArrow(run, "doc_id long, text string, ids binary")


def decode(encoded: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``."""

    @F.arrow_udf("string")
    def text(column: pa.Array) -> pa.Array:
        c = codec(model_file)
        return pa.array([None if x.as_py() is None else c.decode(x.as_py()) for x in column], pa.string())

    return encoded.withColumn("decoded", text(ids))


def op7_piece_codec(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model_file = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(encode(text_table(spark, sf_dir, "documents"), model_file), model_file)
    return out.select(
        "doc_id",
        F.expr("CAST(length(ids) DIV 4 AS LONG)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.length("decoded").cast("long").alias("decoded_chars"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )
