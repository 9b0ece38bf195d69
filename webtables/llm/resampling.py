"""Quality classifier by importance resampling.

Two generative models count hashed n-grams (words and word pairs in ``BUCKETS`` buckets): the target
model over documents labelled good, the raw model over all documents. A document's log-weight is the
mean over its n-grams, and ``PRIOR`` neutral ones, of log target - log raw, times ``SHARPNESS``: every
document counts as one of that many n-grams, so length does not decide. A Gumbel value, a function of the id, is added, and the
k documents of the greatest sums are the sample: drawing without replacement by importance.

The labelled documents are dealt to ``FOLDS`` folds. A labelled document is weighed by the target model without its fold, so all
labels count and none judges itself; every other document by the whole model. ``k`` is not given but counted: a
cutoff of the weight is found that keeps ``KEEP`` of the labelled good documents, less a margin of ``MARGIN`` of the way to the
median of the bad ones, or without any, of as much below as the median of the good ones is above; k is the
number of documents above it.

The labelled sample is bounded: at most ``LABELS`` labelled rows (those of the least hashes). All other counts run over all
documents. What reaches the driver is of fixed size: the buckets, the weights of the labelled, and cells of a
histogram that closes in on the k-th greatest sum.

Defined cases: a text without words (null, empty) has the least weight and is never sampled; equal
sums share their place, so repeated rows are sampled together; a null id counts as one id; without any
document labelled good there is no target model, and every document with a word is kept; texts of any length count
whole; an empty table gives an empty result; other columns are carried untouched.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webtables.llm.common import packed, stored, table, unpacked
from webtables.llm.shingles import gram_hashes, word_hashes

BUCKETS, SHARPNESS, LABELS, FOLDS = 10_000, 300.0, 20_000, 5
KEEP, MARGIN = 0.998, 0.15
#: Neutral n-grams added to every document, so that a few odd words do not decide on a short one.
PRIOR = 50
#: Sums are compared in steps of 2**-20; cells of each round of the search for the k-th.
STEP, ROUND = 1 << 20, 1024


def features(text: str | None) -> np.ndarray:
    """Buckets of the words and word pairs of a whole text."""
    words = word_hashes(text or "")
    return (np.concatenate([words, gram_hashes(words, 2)]) % np.uint64(BUCKETS)).astype(np.int64)


def label_sample(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    """``_label_id, good, fold``: at most ``LABELS`` labelled ids."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("_label_id")).agg((F.min(quality) == 1).alias("good"))
    rows = rows.withColumn("h", F.xxhash64("_label_id", F.lit(1))).orderBy("h", "_label_id").limit(LABELS)
    return rows.select("_label_id", "good", F.pmod("h", F.lit(FOLDS)).cast("int").alias("fold"))


def counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams by bucket of all texts, and of the target ones by fold. ``texts``: (text, fold of a target text)."""
    names = ["bucket", "raw", *[f"t{f}" for f in range(FOLDS)]]

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros((FOLDS, BUCKETS), np.int64)
        for b in batches:
            for t, fold in zip(b.column(0), b.column(1).to_pylist()):
                n = np.bincount(features(t.as_py()), minlength=BUCKETS)
                raw += n
                if fold is not None:
                    target[fold] += n
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.arange(BUCKETS), raw, *target)], names=names)

    found = texts.mapInArrow(run, ", ".join(f"{n} long" for n in names)).groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names[1:]])
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros((FOLDS, BUCKETS), np.int64)
    for bucket, r, *t in found.collect():  # BUCKETS rows
        raw[bucket], target[:, bucket] = r, t
    return raw, target


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log-ratio of each bucket: without each fold, and at the end with all."""
    whole = target.sum(axis=0)
    return np.array([log_ratio(raw, whole - t) for t in target] + [log_ratio(raw, whole)])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def cutoff(good: np.ndarray, bad: np.ndarray) -> float | None:
    """The least mean log-ratio of a document that counts for k; None: there is no target model."""
    if not len(good):
        return None
    low = float(np.quantile(good, 1 - KEEP, method="lower"))
    below = low - float(np.median(bad)) if len(bad) else float(np.median(good)) - low
    return low - MARGIN * max(0.0, below)


def gumbel(doc_id: Column, seed: int) -> Column:
    u = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_greatest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th greatest of a long column, exactly; each round fetches ``ROUND`` counts at most."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = -(-(high - low + 1) // ROUND)
        cell = F.floor((F.col(column) - F.lit(low)) / F.lit(width)) if width > 1 else F.col(column) - F.lit(low)
        cells = dict(rows.where(F.col(column).between(low, high)).groupBy(cell.cast("int").alias("c")).count().collect())
        for c in sorted(cells, reverse=True):
            if cells[c] >= k:
                break
            k -= cells[c]
        low, high = low + c * width, min(high, low + (c + 1) * width - 1)
    return low


class Model(NamedTuple):
    """Log-ratios (see ``ratios``), the labelled sample, and the least sum that is sampled (None: every document with a word)."""

    ratios: np.ndarray
    sample: DataFrame
    least: int | None
    seed: int


def _marked(docs: DataFrame, sample: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_row``, ``_id``, ``_text``, and ``good`` and ``fold`` of labelled rows."""
    rows = packed(docs, doc_id, text)
    rows = rows.select("_row", F.col(f"_{doc_id}").alias("_key"), F.col(f"_{doc_id}").cast("long").alias("_id"), F.col(f"_{text}").cast("string").alias("_text"))
    return rows.join(F.broadcast(sample), F.col("_id") == F.col("_label_id"), "left").drop("_label_id")  # LABELS rows at most


def _scored(rows: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """Rows of ``_marked`` with ``n_grams``, ``mean``, ``log_weight`` and ``sum`` (in steps) instead of the text."""

    @F.pandas_udf("struct<n: long, mean: double>")
    def score(texts: pd.Series, folds: pd.Series) -> pd.DataFrame:
        found = [features(t) for t in texts]
        own = [ratio[int(f)] for f in folds.fillna(FOLDS)]
        return pd.DataFrame({"n": [len(x) for x in found], "mean": [float(r[x].sum() / (len(x) + PRIOR)) if len(x) else None for r, x in zip(own, found)]})

    rows = rows.withColumn("_s", score("_text", "fold"))
    weight = F.col("_s.mean") * SHARPNESS
    total = F.floor((weight + gumbel(F.col("_key"), seed)) * STEP)
    return rows.select("_row", "_id", "good", F.col("_s.n").alias("n_grams"), F.col("_s.mean").alias("mean"), weight.alias("log_weight"), total.alias("sum"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", seed: int = 11) -> Model:
    """Two passes over ``docs``: counts, then sums; the ids, means and sums of the second are kept in the shared folder."""
    sample = stored(label_sample(labels, doc_id, quality), "labels")
    rows = _marked(docs, sample, doc_id, text)
    ratio = ratios(*counts(rows.select("_text", F.when(F.col("good"), F.col("fold")))))
    sums = stored(_scored(rows, ratio, seed).select("_id", "good", "mean", "sum").where("mean IS NOT NULL"), "sums")
    known = sums.where("good IS NOT NULL").groupBy("_id", "good").agg(F.min("mean").alias("mean")).collect()  # LABELS rows at most
    cut = cutoff(np.array([r.mean for r in known if r.good]), np.array([r.mean for r in known if not r.good]))
    k = 0 if cut is None else sums.where(F.col("mean") >= cut).count()
    least = None if cut is None else kth_greatest(sums, "sum", k) if k else 1 << 62
    return Model(ratio, sample, least, seed)


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_row`` (the row), ``n_grams``, ``log_weight`` (null without words), ``sum``, ``kept``."""
    rows = _scored(_marked(docs, model.sample, doc_id, text), model.ratios, model.seed)
    kept = F.col("sum").isNotNull() if model.least is None else F.col("sum") >= model.least
    return rows.select("_row", "n_grams", "log_weight", (F.col("sum") / STEP).alias("sum"), F.coalesce(kept, F.lit(False)).alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``, unchanged."""
    return unpacked(classify(docs, fit(docs, labels)).where("kept"))


def op10_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("_row.doc_id", "n_grams", "log_weight", "sum", "kept")
