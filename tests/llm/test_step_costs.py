"""What steps leave and make: shuffle files of written tables, pairs of long lines, links of large groups."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from test_operators import documents, prose
from voltlake.llm import common, fuzzy_lines, spotsigs


def shuffle_files(spark):
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for place in places for _, _, names in os.walk(place) for f in names if f.startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_deleted(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.CLEANUP)
    table = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "cleaned")
    assert table.count() == 7 and spark.conf.get(common.CLEANUP) == setting
    common.stored(table.repartition(3, "k"), "cleaned")
    kept = shuffle_files(spark) - before  # counting made one exchange of one row, and is not a written table
    assert sum(f.endswith(".data") for f in kept) <= 8


def counting(monkeypatch, module):
    """Rows of the tables that ``module`` writes from now on, by name."""
    rows, real = {}, module.stored

    def stored(frame, name):
        table = real(frame, name)
        rows[name] = rows.get(name, 0) + table.count()
        return table

    monkeypatch.setattr(module, "stored", stored)
    return rows


def test_long_lines_of_one_template_make_no_pairs(spark, monkeypatch):
    """Long lines that share three quarters of their windows: pairs by keys, but far too different to be verified."""
    draw = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz "
    frame = "".join(draw.choice(letters) for _ in range(640))
    lines = ["x" + frame + "".join(draw.choice(letters) for _ in range(130)) + "x" for _ in range(40)]
    rows = counting(monkeypatch, fuzzy_lines)
    found = fuzzy_lines.line_report(documents(spark, [*lines, lines[0] + " end"])).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in found} == {k: int(k == 40) for k in range(41)}
    assert rows["line-buckets"] > 80 and rows["line-pairs"] < 20


def test_parities_are_those_of_the_members(spark):
    draw = random.Random(6)
    sets = [[draw.getrandbits(64) - 2**63 for _ in range(n)] for n in (1, 5, 300)]
    got = common.parities(spark.createDataFrame(list(enumerate(sets)), "id long, members array<long>"), 16).collect()
    for row in got:
        words = [0] * 16
        for h in sets[row["id"]]:
            words[(h >> 6) & 15] ^= 1 << (h & 63)
        assert [row[f"p{k}"] % 2**64 for k in range(16)] == words
    assert len(got) == 3


def test_alike_ids_of_a_bucket_make_links_in_proportion(spark):
    """A group of 400 alike sets: some pairs each, after which most are joined."""
    n, base = 400, list(range(1000, 1200))
    sets = [(k, [*base, 10_000 + k]) for k in range(n)]
    frame = spark.createDataFrame(sets, "id long, members array<long>")
    buckets = frame.select(F.lit(1).alias("key"), "id", F.size("members").alias("n"), F.size("members").alias("rest"))
    known = spark.createDataFrame([], "node long, component long, size long")
    pairs = common.drawn_candidates(buckets, known, 0.8, common.parities(frame, 4))
    assert 0 < pairs.count() < n * common.DRAWN
    found = common.components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    assert found.select("node").distinct().count() > 0.9 * n


def test_signature_sets_of_a_large_group(spark, monkeypatch):
    """Near copies without a common least one: the result of all pairs, with few of the links."""
    draw = random.Random(9)
    anchors = ["the", "of", "und", "la"]
    base = [draw.choice(anchors) if k % 2 else f"w{k}" for k in range(160)]
    texts = []
    for _ in range(160):
        own = list(base)
        for k in draw.sample(range(80), 3):
            own[2 * k] = f"w{2 * k}x{draw.randint(0, 5)}"
        texts.append(" ".join(own))
    rows = counting(monkeypatch, spotsigs)
    found = {r["doc_id"]: r for r in spotsigs.near_duplicates(documents(spark, texts)).collect()}
    assert len(found) == len(texts) and len({r["component_id"] for r in found.values()}) < 10
    assert rows["spot-edges"] < len(texts) ** 2 / 8
