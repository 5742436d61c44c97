"""Near copies: what is done for pairs that share a rare shingle but are not alike."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from voltlake.llm import simhash


def test_pairs_that_are_not_alike_make_no_sets(spark, monkeypatch):
    """Pairs of texts share a third of their shingles; with no sample to order them, nearly every pair is a candidate."""
    texts = []
    for k in range(30):
        shared = [f"s{k}x{i}" for i in range(60)]
        texts += [" ".join(shared + [f"o{k}{side}x{i}" for i in range(60)]) for side in "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, candidates, real, meet = [], [], simhash.stored, simhash.bucket_candidates

    def stored(frame, name):
        table = real(frame, name)
        if name == "copy-sets":
            sets.append(table.count())
        return table

    def bucket_candidates(*args):
        pairs = real(meet(*args), "met")
        candidates.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash, "stored", stored)
    monkeypatch.setattr(simhash, "bucket_candidates", bucket_candidates)
    found = simhash.near_copies(docs, sample_rows=1)
    assert sorted(tuple(r) for r in found.collect()) == [(k, k) for k in range(60)]
    assert candidates[0] >= 25 and sum(sets) == 0


def test_parities_are_no_farther_apart_than_the_sets(spark):
    """Sets of other sizes have parities of other lengths, which are compared in the shorter one."""
    draw, rows = random.Random(5), []
    for size in (0, 1, 5, 63, 64, 65, 70, 127, 129, 140, 1000, 1030):
        a = {draw.getrandbits(64) - 2**63 for _ in range(size)}
        for gone in (0, 1, size // 9, size // 2):
            for new in (0, 1, size // 9, size * 3):
                b = set(draw.sample(sorted(a), size - min(gone, size))) | {draw.getrandbits(64) - 2**63 for _ in range(new)}
                words = [simhash.set_parity(np.array(sorted(own), np.int64)).tolist() for own in (a, b)]
                rows.append((*words, len(a ^ b)))
    pairs = spark.createDataFrame(rows, "pa array<long>, pb array<long>, apart int")
    got = pairs.select("apart", simhash._bits_apart(F.col("pa"), F.col("pb")).alias("bits")).collect()
    assert all(r["bits"] <= r["apart"] and (r["apart"] - r["bits"]) % 2 == 0 for r in got)
    assert sum(r["bits"] > 0 for r in got) > len(got) // 2
    assert {len(words) for row in rows for words in row[:2]} >= {1, 2, 4, 16, 32, 64}


def test_pairs_just_alike_are_found_at_every_size(spark):
    """The texts differ in their last shingles only, by as many as a likeness of 0.8 allows, or by one more."""
    texts, alike = [], {}
    for k, size in enumerate((9, 36, 63, 64, 72, 126, 135, 513, 1026)):
        most = size // 9  # of size shingles each, with this many others: (size - most) / (size + most) >= 0.8
        for others in (most, most + 1):
            own = [f"w{k}x{others}x{i}" for i in range(size + 4)]
            a, b = " ".join(own), " ".join(own[: len(own) - others] + [f"v{k}x{i}" for i in range(others)])
            one, two = (set(simhash.shingle_set(text, 5).tolist()) for text in (a, b))
            alike[len(texts) + 1] = len(one & two) >= 0.8 * len(one | two) - 1e-9
            texts += [a, b]
    assert sum(alike.values()) == 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    assert found == {k: k - 1 if alike.get(k) else k for k in range(len(texts))}


def test_few_documents_to_drop_are_broadcast(spark):
    """The texts of all documents would be shuffled else."""
    docs = spark.createDataFrame([(1, "one two three"), (2, "one two three"), (None, "one two three"), (3, None)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.deduplicate(docs)
        assert "BroadcastHashJoin" in kept._jdf.queryExecution().executedPlan().toString()
        assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(1, "one two three"), (None, "one two three"), (3, None)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
