"""The pipeline's stages, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from tests.llm.test_operators import PATTERNS, brute_groups
from webtables.llm.bpe import Bpe
from webtables.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "secret_scan", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), "stage")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            groups = brute_groups([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], 5, 80)
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, (_, label) in groups.items() if i == label}
    lost = {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()} - {r.doc_id for r in seen["quality_classifier"].select("doc_id").collect()}
    clean = {i for i, q in labels.items() if q == 1}
    assert len(lost & clean) <= 0.05 * len(clean) and len(lost - clean) > 0
    texts = {r.doc_id: r.text for r in seen["secret_scan"].select("doc_id", "text").collect()}
    assert set(texts) == {r.doc_id for r in seen["near_duplicates"].select("doc_id").collect()}
    assert not any(ok(m) for t in texts.values() for _, p, ok in PATTERNS for m in p.finditer(t))
    encoder, got = Bpe(public_tokenizers.path("byte_bpe_50k.json")), {}
    for p in docs.orderBy("doc_id", "start").collect():
        got[p.doc_id] = got.get(p.doc_id, b"") + p.ids
    assert got == {i: encoder.whole(t) + bytes(4) for i, t in texts.items()}
