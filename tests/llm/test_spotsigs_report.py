"""The whole report of signature sets: components against all pairs, repeated rows, null keys."""

from __future__ import annotations

import random

from voltlake.llm import spotsigs

SCHEMA = "doc_id long, text string, near_key int, set_id string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in rows], SCHEMA)


def test_components_equal_all_pairs(spark):
    draw = random.Random(11)
    anchors = ["the", "of", "und", "la"]
    texts = []
    for _ in range(12):
        words = [draw.choice(anchors) if k % 2 else f"w{draw.randint(0, 5000)}" for k in range(80)]
        for _ in range(8):
            texts.append(" ".join(words))
            words = list(words)
            words[2 * draw.randint(0, 39)] = f"n{draw.randint(0, 5000)}"
    texts += ["", None, "...", "alone", texts[0], texts[0]]
    rows = {r["doc_id"]: r for r in spotsigs.full_report(documents(spark, enumerate(texts))).collect()}
    assert len(rows) == len(texts)
    sets = {}
    for k, r in rows.items():
        printed = r["fingerprint"]
        sets[k] = {printed[i:i + 8] for i in range(0, len(printed), 8)}
        assert len(sets[k]) == r["n_signatures"]
    least = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = sets[a] | sets[b]
                if least[b] < least[a] and (not both or len(sets[a] & sets[b]) >= spotsigs.SIMILARITY * len(both)):
                    least[a], changed = least[b], True
    assert {k: r["component_id"] for k, r in rows.items()} == least
    assert 1 < len(set(least.values())) < len(texts) - 20
    by_set = {}
    for k, r in rows.items():
        assert by_set.setdefault(r["set_id"], r["fingerprint"]) == r["fingerprint"]


def test_repeated_rows_and_null_keys(spark):
    rows = [(1, "the river runs"), (1, "the river runs"), (1, "of stone"), (None, "the river runs"), (None, None), (2, "")]
    got = spotsigs.full_report(documents(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "1", "2", "None", "None"]
    assert sorted(r["n_chars"] for r in got if r["doc_id"] == 1) == [8, 14, 14]
    assert spotsigs.full_report(documents(spark, rows).limit(0)).count() == 0
