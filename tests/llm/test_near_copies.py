"""The near-dedup stage goes through SimHash links; the rarest shingles find what is farther apart."""

from __future__ import annotations

import corpus_pipeline
from voltlake.llm import simhash

WORDS = [f"w{k * 7919 % 1000}" for k in range(400)]


def documents(spark):
    near, far = list(WORDS), list(WORDS)
    near[-1] = "end"  # one shingle of 396
    for k in range(20, 220, 20):
        far[k] = f"other{k}"  # 50 shingles: Jaccard 346 / 446 is below 0.8
    texts = [" ".join(WORDS), " ".join(near), " ".join(far), "a text of its own, with some words", " ".join(WORDS).upper(), None, ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_stage_links_fingerprints(spark, monkeypatch):
    """Links of fingerprints alone join near copies, verified by their sets; the other path finds no candidate here."""
    monkeypatch.setattr(simhash, "bucket_candidates", lambda buckets, known, similarity: buckets.selectExpr("id AS a", "id AS b").limit(0))
    first, near = (simhash.fingerprint_bytes(" ".join(w), 3) for w in (WORDS, [*WORDS[:-1], "end"]))
    assert (first ^ near).bit_count() <= 3
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, documents(spark), "").collect()}
    assert kept == {0, 2, 3, 5}


def test_links_change_no_result(spark):
    for radius in (-1, 0, 3):
        found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(documents(spark), radius=radius).collect()}
        assert found == {0: 0, 1: 0, 2: 2, 3: 3, 4: 0, 5: 5, 6: 5}
