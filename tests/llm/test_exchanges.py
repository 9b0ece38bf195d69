"""Collocations, repeated passages and the Merkle manifest against plain Python."""

from __future__ import annotations

import gc
import hashlib
import random
import re
import weakref
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from webtables.llm import blocks, collocations, merkle, repeats

LOWER = {c: c + 32 for c in range(65, 91)}
#: Null, empty, blank and odd texts, one without spaces, a long one and a repeated one.
ODD = [None, "", " \n\t", "one", "a b. a b\x0bA B", "é😀 季 ▁", "x" * 5000, "ha " * 2000, "same text twice " * 30, "same text twice " * 30]


def docs_of(spark, rows, parts=3):
    """Documents (id, text, lang) with columns whose names the operators use themselves."""
    rows = [(*r, "p", 1, "k", None, "tree") for r in rows]
    schema = "doc_id long, text string, lang string, phrase string, block int, path string, n_bytes long, source string"
    return spark.createDataFrame(rows, schema).repartition(parts)


def texts(seed, n):
    """Texts with copies, near copies, shared passages at any offset, and repeats within a text."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 6))) for _ in range(60)]

    def prose(k):
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(k))

    passages = [prose(30) for _ in range(3)] + [prose(200)[:100], prose(200)[:99]]
    out = []
    for _ in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(rng.choice(out))
        elif out and kind < 0.45:
            t = list(rng.choice(out))
            for _ in range(rng.randint(1, 3)):
                if t:
                    k = rng.randrange(len(t))
                    t[k : k + rng.randint(0, 2)] = rng.choice(["z", "", "yy"])
            out.append("".join(t))
        else:
            t = prose(rng.randint(0, 120))
            for _ in range(rng.randint(0, 2)):
                k = rng.randint(0, len(t))
                t = t[:k] + rng.choice(passages) + t[k:]
            out.append(t)
    return out


# 11
def plain_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    gone = {(lang, w[i : j]) for (lang, w), c in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and f[lang, w[i:j]] <= c}
    per = {}
    for (lang, w), a in found.items():
        if (lang, w) not in gone:
            s, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            per.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, l, q, n[lang], -s) for lang, found in per.items() for r, (s, a, p, l, q) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("seed, sizes", [(0, {}), (1, {"block_bytes": 700, "slice_bytes": 120, "mass": 500}), (2, {"block_bytes": 1, "slice_bytes": 7, "mass": 64})])
def test_collocations(spark, seed, sizes):
    langs = ["en", "en", "en", None, "und", "é"]
    rows = [(i, t, langs[i % 6]) for i, t in enumerate(ODD + texts(seed, 60))]
    got = sorted(tuple(r) for r in collocations.collocations(docs_of(spark, rows), 4, 40, **sizes).collect())
    assert got == plain_collocations(rows, 4, 40)
    assert len(got) > 60


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(docs_of(spark, []).limit(0), 2).count() == 0


def test_slices_go_when_they_are_done():
    """Words and their numbers held each other, so a worker kept the slices of many blocks."""
    gc.disable()
    try:
        some, seen = collocations.slices(((lang, b"a b. a c") for lang in ("en", "de", "en", "fr")), 9), []
        for s in some:
            assert not [x for x in seen if x() is not None]
            names = np.sort(np.concatenate([names[places + n > s.context] for n, places, names in collocations.phrases(s)]))
            assert (collocations.names_of(s) == names).all()
            seen.append(weakref.ref(s))
            del s
        assert len(seen) == 4
    finally:
        gc.enable()


def test_summaries_keep_what_is_frequent():
    rng = np.random.default_rng(0)
    for trial in range(30):
        least, n = int(rng.integers(2, 30)), int(rng.integers(1, 3000))
        stream = np.minimum(rng.zipf(1.3, n), 500).astype(np.uint64)
        capacity = n // least + 1
        summary = collocations.Summary(capacity)
        for part in np.array_split(stream, rng.integers(1, 9)):
            keys, counts = np.unique(part, return_counts=True)
            summary.merge(keys, counts)
            summary.settle()
        assert summary.taken < least and len(summary.keys) <= capacity
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= least]) <= set(summary.frequent(least))


def test_keys_travel_whole():
    rng = np.random.default_rng(1)
    for n, high in ((0, 1), (1, 1), (1, 2**64 - 1), (1000, 2**64 - 1), (5000, 70_000)):
        keys = np.unique(rng.integers(0, high, n, dtype=np.uint64))
        assert (blocks.decoded(blocks.encoded(keys)) == keys).all()


# 12
def plain_repeats(rows):
    seen, out = set(), []
    data = sorted(((i is not None, i or 0, xxhash.xxh32_intdigest((t or "").encode())), (t or "").encode()) for i, t, _ in rows)
    for (has, i, _), b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i if has else None, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, sizes", [
    (0, {}),
    (1, {"block_bytes": 2000, "slice_bytes": 300, "samples": 50, "bucket_bytes": 300}),
    (2, {"block_bytes": 1, "slice_bytes": 1, "samples": 1 << 20, "bucket_bytes": 1 << 20}),
])
def test_repeats(spark, seed, sizes):
    if seed == 2:
        rows = [(i, t[:260], "en") for i, t in enumerate(texts(seed, 12))]
    else:
        more = texts(seed, 70)
        rows = [(i, t, "en") for i, t in enumerate(ODD + more)] + [(5, more[3], "en"), (5, more[3], "en"), (None, more[4], None), (None, None, None), (-7, more[5], "en")]
        rows += [(1000, "xy" * 400, "en"), (1001, more[0] + more[1] + more[2] * 3, "en")]
    got = repeats.repeats(docs_of(spark, rows), with_text=True, **sizes).collect()
    flat = [(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got]
    assert sorted(flat, key=repr) == plain_repeats(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_repeats_of_an_empty_table(spark):
    assert repeats.repeats(docs_of(spark, []).limit(0)).count() == 0


def test_the_cover_meets_every_difference():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


# 13
def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(r):
        return H("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r)

    def tree(nodes):
        """(root, proof of each node as a list of (siblings before, siblings after))."""
        proofs, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(proofs):
                first = at[k] // 8 * 8
                run = nodes[first : first + 8]
                p.append((run[: at[k] - first], run[at[k] - first + 1 :]))
                at[k] //= 8
            nodes = [H(nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        return nodes[0], proofs

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (own, *tree([leaf(r) for r in own]))
    root, outer = tree([trees[lang][1] for lang in langs])
    out = []
    for lang, outer_proof in zip(langs, outer):
        own, subroot, proofs = trees[lang]
        for r, proof in zip(own, proofs):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = text.translate(LOWER)
            f = leaf((*r[:4], text))
            for before, after in proof + outer_proof:
                f = H([*before, f, *after])
            out.append((r[0], leaf(r), subroot, root, H(x for b, a in proof + outer_proof for x in b + a), f, f == root))
    return sorted(out, key=repr)


def manifest_of(spark, rows, height=merkle.LEVELS):
    docs = spark.createDataFrame([(*r, "extra", 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int").repartition(4)
    return sorted((tuple(r) for r in merkle.manifest(merkle.document_leaves(docs), height).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 9, 700])
def test_manifest(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["s", None, "é"]), rng.choice(["en", "en", None, "de", ""]), rng.choice([3, None]), rng.choice(["Abc", "abc", None, "", "É" * 50])) for i in range(n)]
    if n == 700:
        rows += [rows[5], rows[5], (5, "other", "en", 1, "X"), (None, None, None, None, None), (None, "s", "en", 0, "A"), (-3, "s", "en", 0, "LONG " * 30_000)]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_over_superblocks(spark):
    rows = [(i, "s", f"l{i % 11}" if i % 2 else "en", i, f"T{i}") for i in range(300)]
    assert manifest_of(spark, rows, 1) == plain_manifest(rows)


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(merkle.document_leaves(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string"))).count() == 0


# 2
def test_the_least_id_stays_whatever_else_is_in_the_table(spark):
    from webtables.llm import near_dup

    rows = [(10, "a b c d e f g h", "en"), (2, "a b c d e f g h", "en"), (50, "q r s t u v w", "en"), (None, "a b c d e f g h", "en")]
    for more in ([], [(50, "other words stand in this row", "en")], [(2, "a b c d e f g h", "en"), (60, None, None)]):
        got = sorted((r.doc_id, r.text) for r in near_dup.keep_one(docs_of(spark, rows[: 4 if more else 3] + more), 5, 80).collect())
        assert [g for g in got if g[1] == rows[0][1]] == [(2, rows[0][1])]
        assert len(got) == 2 + (len(more) if len(more) == 1 else len(more) // 2)


# 10
def test_resampling_against_plain_python(spark):
    import math

    from pyspark.sql import functions as F

    from webtables.llm import resampling as R
    from webtables.llm.shingles import gram_hashes, word_hashes

    rng = random.Random(8)
    good_words, bad_words = "the of and river stone walks light under".split(), "buy $$$ click now the !!! win".split()
    texts_ = [" ".join(rng.choice(good_words if rng.random() < 0.8 else bad_words) for _ in range(rng.randint(1, 60))) for _ in range(220)]
    texts_ += [" ".join(rng.choice(bad_words if rng.random() < 0.8 else good_words) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ODD
    rows = [(i, t, "en") for i, t in enumerate(texts_)] + [(3, texts_[3], "en"), (None, texts_[4], "en")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 220)) for i in range(0, 280, 2)], "doc_id long, quality int")
    sample = {r["_label_id"]: (r.good, r.fold) for r in R.label_sample(labels, "doc_id", "quality").collect()}

    def buckets(t):
        words = word_hashes(t or "")
        return [int(h) % R.BUCKETS for h in [*words, *gram_hashes(words, 2)]]

    raw, target = Counter(), [Counter() for _ in range(R.FOLDS)]
    for i, t, _ in rows:
        raw.update(buckets(t))
        if sample.get(i, (False, 0))[0]:
            target[sample[i][1]].update(buckets(t))

    def mean(i, t):
        b = buckets(t)
        left = [c for f, c in enumerate(target) if i not in sample or f != sample[i][1]]
        whole, total = sum(left, Counter()), sum(raw.values())
        size = sum(whole.values())
        ratio = [math.log((whole[x] + 1) / (size + R.BUCKETS)) - math.log((raw[x] + 1) / (total + R.BUCKETS)) for x in b]
        return sum(ratio) / (len(b) + R.PRIOR) if b else None

    means = {(i, t): mean(i, t) for i, t, _ in rows}
    known = {i: min(m for (j, _), m in means.items() if j == i) for i in sample}
    cut = R.cutoff(np.array([m for i, m in known.items() if sample[i][0]]), np.array([m for i, m in known.items() if not sample[i][0]]))
    noise = {r.doc_id: r.g for r in docs.select("doc_id", R.gumbel(F.col("doc_id"), 11).alias("g")).collect()}
    sums = {key: math.floor((m * R.SHARPNESS + noise[key[0]]) * R.STEP) for key, m in means.items() if m is not None}
    each = sorted((sums[i, t] for i, t, _ in rows if (i, t) in sums), reverse=True)
    least = each[sum(m >= cut for i, t, _ in rows if (m := means[i, t]) is not None) - 1]
    got = R.classify(docs, R.fit(docs, labels)).collect()
    assert len(got) == len(rows)
    for r in got:
        key = (r["_row"].doc_id, r["_row"].text)
        assert r.n_grams == len(buckets(key[1]))
        if means[key] is None:
            assert r.log_weight is None and not r.kept
        else:
            assert abs(r.log_weight - means[key] * R.SHARPNESS) < 1e-6
            assert abs(r["sum"] * R.STEP - sums[key]) < 1000 and (r.kept == (sums[key] >= least) or abs(sums[key] - least) < 1000)
    assert sum(r.kept for r in got if r["_row"].doc_id in range(220, 280)) < 20 < 200 < sum(r.kept for r in got)
