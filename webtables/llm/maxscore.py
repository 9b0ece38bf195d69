"""Exact top-k inner-product search by MaxScore over dimension postings.

A vector is a document whose terms are its dimensions; the posting of dimension d holds the component
x_d of every candidate of a shard. For a query q a term adds q_d * x_d, which lies between two bounds
known for each shard from the least and greatest x_d. A term's *range* is the distance of its bounds:
what it can add over its lower bound. For each query and shard the terms are split at the threshold
(the k-th best score so far): the terms of the smallest ranges, which together cannot lift a
candidate from the sum of lower bounds to the threshold, are non-essential. Essential postings are
traversed for a block of candidates; the others are probed, greatest range first, only for candidates
whose score so far plus the remaining upper bounds still reaches the threshold. Bounds are never
estimates, so the result is exact. Each shard gives its best k per query; these are merged.

Shards hold ``shard_rows`` candidates and query blocks ``block_rows`` queries, each packed into one
row. A block of queries meets every shard by an equi-join on the pair of numbers.

Defined cases: rows whose id is null, or whose vector is null or holds null or non-finite components, take no part; of
shorter vectors the missing components are 0; repeated rows of an id: equal vectors count once, and
different ones are candidates each, ranked by score; a query with several vectors is ranked by the
best of them for each candidate; a query without candidates has no rows; an empty table
gives no rows; other columns are not read. Scores beyond 64 bits are an error.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webtables.llm.common import stored

SCALE, TOP = 256, 5
#: Candidates of a shard and of a traversal step; queries of a block.
SHARD_ROWS, STEP_ROWS, BLOCK_ROWS = 16384, 2048, 1024
#: Up to this bound on the absolute value of any score, doubles hold it exactly.
EXACT = 2**53


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: components as floor(scale * component), of the rows that take part, each once."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: F.coalesce((x == x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    rows = df.where(F.col(f"`{vec_id}`").isNotNull() & v.isNotNull() & finite)
    x = F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    return rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x")).dropDuplicates()


def _packed(df: DataFrame, number: str) -> DataFrame:
    """One row per ``number``: its ids and vectors, by id."""
    return df.groupBy(number).agg(F.sort_array(F.collect_list(F.struct("vec_id", "x"))).alias("rows")).select(number, F.col("rows.vec_id").alias("ids"), F.col("rows.x").alias("xs"))


def _matrix(xs) -> np.ndarray:
    """Rows of integers → a matrix, zero-filled on the right."""
    lengths = np.diff(xs.offsets.to_numpy())
    width = int(lengths.max(initial=0))
    flat = xs.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(xs), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


class _Best:
    """The k best (score, smaller id first) of one query in a shard."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores, ids):
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)  # an id's best vector only
        order = order[np.sort(first)][: self.k]
        self.scores, self.ids = scores[order], ids[order]

    @property
    def threshold(self):
        return self.scores[-1] if len(self.scores) == self.k else None


def search_shard(q_ids, q, c_ids, c, k: int, step: int = STEP_ROWS):
    """Best k of the candidates ``c`` for each query row of ``q``: arrays query_id, vec_id, score."""
    width = max(q.shape[1], c.shape[1])
    q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
    c = np.pad(c, ((0, 0), (0, width - c.shape[1])))
    big = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, width)
    kind = np.float64 if big < EXACT else object  # object: Python's integers, exact at any size
    postings = np.ascontiguousarray(c.T).astype(kind)
    q = q.astype(kind)
    low, high = (postings.min(axis=1), postings.max(axis=1)) if len(c) else (np.zeros(width), np.zeros(width))
    out = []
    blocks = [np.ascontiguousarray(postings[:, s : s + step]) for s in range(0, len(c), step)]
    for qid, w in zip(q_ids, q):
        a, b = w * low, w * high
        least, most = np.minimum(a, b), np.maximum(a, b)
        order = np.argsort(-(most - least), kind="stable")  # greatest range first
        # rest[i]: the most that the terms order[i:] can add to a score
        rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0]])
        # reach[i]: the best score of a candidate at its lower bound in the terms order[:i]
        reach = np.concatenate([[0], np.cumsum(least[order])]) + rest
        best = _Best(k)
        for n, block in enumerate(blocks):
            ids = c_ids[n * step : n * step + step]
            least_score = best.threshold
            if least_score is None:
                essential = width
            else:
                if rest[0] < least_score:
                    break
                # the longest tail of terms that cannot lift a candidate to the threshold
                essential = int(np.argmax(reach < least_score)) if (reach < least_score).any() else width
            live = np.flatnonzero(ids != qid)
            terms = order[:essential]
            scores = (w[terms] @ block[terms])[live] if essential else np.zeros(len(live), kind)
            at = essential
            while at < width and len(live):
                ok = scores + rest[at] >= least_score
                live, scores = live[ok], scores[ok]
                terms = order[at : at + 8]
                scores = scores + w[terms] @ block[np.ix_(terms, live)]
                at += len(terms)
            if least_score is not None:
                ok = scores >= least_score
                live, scores = live[ok], scores[ok]
            if len(live) > 4 * k:  # what lies below the k-th best of this block's different ids cannot stay
                cut = np.sort(scores)[-len(live) // 2] if len(live) > 64 else None
                if cut is not None and len(np.unique(ids[live[scores >= cut]])) >= k:
                    live, scores = live[scores >= cut], scores[scores >= cut]
            if len(live):
                best.add(np.array([int(s) for s in scores], np.int64) if kind is object else scores.astype(np.int64), ids[live])
        out.append((np.full(len(best.ids), qid), best.ids, best.scores))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def top_k(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = TOP, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k best other ids for each id that ``is_query`` takes.

    ``vectors``: ``vec_id, x`` as ``integer_vectors`` gives them.
    """
    counts = vectors.agg(F.count("*"), F.count_if(is_query(F.col("vec_id")))).first()
    shards, blocks = max(1, -(-counts[0] // shard_rows)), max(1, -(-counts[1] // block_rows))

    def number(n, salt):
        return F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")

    def all_of(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    c = _packed(vectors.withColumn("shard", number(shards, 1)), "shard").select("shard", all_of(blocks).alias("block"), F.col("ids").alias("c_ids"), F.col("xs").alias("c_xs"))
    q = _packed(vectors.where(is_query(F.col("vec_id"))).withColumn("block", number(blocks, 2)), "block").select("block", all_of(shards).alias("shard"), F.col("ids").alias("q_ids"), F.col("xs").alias("q_xs"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                ids = {n: one.column(n).flatten().to_numpy() for n in ("q_ids", "c_ids")}
                xs = {n: _matrix(one.column(n).flatten()) for n in ("q_xs", "c_xs")}
                found = search_shard(ids["q_ids"], xs["q_xs"], ids["c_ids"], xs["c_xs"], k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    pairs = q.hint("merge").join(c, ["shard", "block"]).select("q_ids", "q_xs", "c_ids", "c_xs")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op1_maxscore(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(stored(vectors, "vectors"), lambda i: i % 50 == 0)


def sql() -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"""
