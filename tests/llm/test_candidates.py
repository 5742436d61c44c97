"""Candidate pairs: links are kept, pairs that cannot link are neither joined nor written, finished tables are deleted."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from test_operators import documents, prose
from voltlake.llm import common, spotsigs


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_parity_drops_no_pair_that_is_alike(spark):
    draw = random.Random(3)
    core = [draw.getrandbits(63) - 2**62 for _ in range(60)]
    sets = []
    for _ in range(120):
        own = set(draw.sample(core, draw.randint(46, 60))) | {draw.getrandbits(63) - 2**62 for _ in range(draw.randint(0, 6))}
        sets.append(own)
    frame = spark.createDataFrame([(k, sorted(own)) for k, own in enumerate(sets)], "id long, members array<long>").cache()
    buckets = frame.select(F.lit(1).alias("key"), "id", F.size("members").alias("n"), F.size("members").alias("rest"))
    known = spark.createDataFrame([], "node long, component long, size long")
    parities = frame.select("id", *common.parity(F.col("members")))

    def pairs(words):
        return {(r["b"], r["a"]) for r in common.bucket_candidates(buckets, known, 0.8, words).collect()}

    every, fewer = pairs(None), pairs(parities)
    alike = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if jaccard(sets[a], sets[b]) >= 0.8}
    assert alike and alike <= fewer <= every and len(fewer) < len(every) / 2


def test_finished_tables_are_deleted(spark):
    """No step leaves the signature sets in the shared folder."""
    docs, folder = documents(spark, [prose(k // 2, 80) for k in range(40)]), common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    spotsigs.near_duplicates(docs).count()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"spot-sets", "spot-classes", "spot-buckets", "spot-pairs"}
