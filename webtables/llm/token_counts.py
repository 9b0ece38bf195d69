"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a run of documents are the keys of a trie. Walked in sorted order, only the
nodes from the root to the present key are held: each node has the forward score (best score of a
segmentation of its prefix) and that segmentation's number of pieces. What a key shares with the one
before it is not computed again. A key's count is kept at its terminal; a document's count is the sum
over its pre-tokens.

Documents are counted in their own partitions, run by run (``RUN_CHARS`` characters); counts of earlier
runs are remembered up to a bound, which changes the work and not the result.

Defined cases: a null or empty text has no tokens; rows are counted each on its own; a null id is
carried; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from webtables.llm.unigram import SPACE, Unigram, unigram, words_of

RUN_CHARS, REMEMBERED = 2_000_000, 1_000_000


def trie_counts(model: Unigram, keys: Iterable[str]) -> dict[str, int]:
    """Pieces of the best segmentation of ``SPACE + key`` for each key without a space letter in it.

    Space letters inside a key are plain characters without a piece of their own.
    """
    counts: dict[str, int] = {}
    pieces, longest = model.pieces, model.longest
    path = ""  # the present key, space letter first
    best: list[tuple[int, int]] = [(0, 0)]  # at depth d: (score, -pieces) of path[:d]
    for key in sorted(keys):
        word = SPACE + key
        shared, top = 0, min(len(path), len(word))
        while shared < top and path[shared] == word[shared]:
            shared += 1
        del best[shared + 1 :]
        for d in range(shared + 1, len(word) + 1):
            c = word[d - 1]
            if d > 1 and (c == SPACE or c not in pieces):
                score, n = model.byte_cost(c)
                s, k = best[d - 1]
                found = (s + score, k - n)
            else:
                found = None
            if d == 1 or c != SPACE:
                for start in range(max(0, d - longest), d):
                    p = pieces.get(word[start:d])
                    if p is not None and (start == 0 or word[start] != SPACE):
                        s, k = best[start]
                        if found is None or (s + p[1], k - 1) > found:
                            found = (s + p[1], k - 1)
            best.append(found)
        counts[key] = -best[len(word)][1]
        path = word
    return counts


def count_tokens(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, n_pretokens, n_tokens`` of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        model, known = unigram(model_file), {}

        def counted(ids, texts):
            nonlocal known
            words = [words_of(t) for t in texts]
            new = set().union(*words).difference(known)
            if len(known) + len(new) > REMEMBERED:
                new = set().union(*words)
                known = {}
            known.update(trie_counts(model, new))
            sizes = [[len(t) for t in texts], [len(w) for w in words], [sum(map(known.__getitem__, w)) for w in words]]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(s, pa.int64()) for s in sizes]], schema=schema)

        for b in batches:
            ids, texts, chars = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(d)
                texts.append(t.as_py() or "")
                chars += len(texts[-1])
                if chars >= RUN_CHARS:
                    yield counted(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield counted(ids, texts)

    rows = docs.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    return rows.mapInArrow(run, "doc_id long, n_chars long, n_pretokens long, n_tokens long")


def op5_trie_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
