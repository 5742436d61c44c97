"""Cases that once went wrong: ties without end, keys that are null or repeated, repeated words, lines that were lost."""

from __future__ import annotations

import base64
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from test_operators import documents, prose
from voltlake.llm import decontaminate, fuzzy_lines, secrets, sentencepiece_lattice

MODEL = sentencepiece_lattice.DEFAULT_MODEL


@pytest.mark.parametrize("unit", [
    "x" * 203, "x" * 803, *("x" * n for n in range(4_990, 5_001)), "".join(chr(0x4E00 + (k * 7919) % 6000) for k in range(20_000)),
    base64.b64encode(random.Random(3).randbytes(6_000)).decode(), "ab" * 2_501, "-" * 3_001,
])
def test_every_unit_ends(unit):
    model = sentencepiece_lattice.piece_model(MODEL)
    began = time.time()
    found = model.nbest_unit("▁" + unit, 3)
    assert time.time() - began < 10 and len(found) == (1 if ord(unit[0]) > 0x4000 else 3)
    assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True) and len({ids for _, ids in found}) == len(found)
    assert all(model.decode(list(ids)) == unit for _, ids in found)


def test_tied_units_have_the_n_best_scores():
    model = sentencepiece_lattice.piece_model(MODEL)
    for unit in ("▁xxxxxxx", "▁ababab", "----------", "▁11111111"):
        ways = {0: [0.0]}
        for end, edges in enumerate(model.edges(unit), 1):
            ways[end] = sorted((s + score for start, score, _ in edges for s in ways[start]), reverse=True)
        for n in (1, 2, 5, 9):
            assert [s for s, _ in model.nbest_unit(unit, n)] == pytest.approx(ways[len(unit)][:n])


def plain_tiles(words, item, size):
    """Greedy string tiling by looking at every pair of places, again and again."""
    used_d, used_i, found = set(), set(), []
    while True:
        best = (0, 0, 0)
        for d in range(len(words)):
            for i in range(len(item)):
                k = 0
                while (d + k < len(words) and i + k < len(item) and words[d + k] == item[i + k]
                       and d + k not in used_d and i + k not in used_i):
                    k += 1
                best = max(best, (k, -d, -i))
        k, d, i = best[0], -best[1], -best[2]
        if k < size:
            return found
        found.append(k)
        used_d.update(range(d, d + k))
        used_i.update(range(i, i + k))


def test_tiling_matches_the_plain_way(spark):
    draw = random.Random(9)
    words = [[draw.choice("abc") * 3 for _ in range(draw.randint(0, 40))] for _ in range(60)]
    items = [[draw.choice("abc") * 3 for _ in range(draw.randint(1, 16))] for _ in range(12)]
    words += [[*item[8:], "zzz", *item[:8]] for item in items] + [["aaa"] * 60, [], ["bbb", "aaa"] * 20]
    benchmark = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    docs = documents(spark, [" ".join(w) for w in words])
    got = {
        (r["doc_id"], r["item_id"]): (r["covered"], r["n_tiles"])
        for r in decontaminate.contamination(docs, benchmark, min_match=3, threshold=0.3).collect()
    }
    for d, w in enumerate(words):
        for i, item in enumerate(items):
            tiles = plain_tiles(w, item, 3)
            want = (sum(tiles), len(tiles)) if sum(tiles) >= 0.3 * len(item) else None
            assert got.get((d, i)) == want, (w, item)


def test_repeated_words_meet_as_runs(spark):
    one = spark.createDataFrame([(1, "word " * 60)], "item_id long, text string")
    rows = decontaminate.contamination(documents(spark, ["word " * 5_000]), one).collect()
    assert [(r["covered"], r["n_tiles"]) for r in rows] == [(60, 1)]


def test_null_and_repeated_keys_in_decontamination(spark):
    item = prose(5, 40)
    texts, ids = [item, prose(6, 40), prose(7, 40), f"{prose(8, 5)} {item}", None, ""], [None, None, 7, 7, None, None]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, texts, ids).withColumnRenamed("gram", "row")
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(0, texts[1]), (7, texts[2]), (0, ""), (0, "")])
    assert decontaminate.decontaminate(docs, benchmark.limit(0)).count() == 6
    assert decontaminate.decontaminate(docs.limit(0), benchmark).count() == 0


def test_rows_that_share_a_key_lose_no_lines(spark):
    texts, ids = ["first line here\nunique line B", "another line C\nfirst line here", "first line here", "first line here"], [1, 1, None, 2]
    rows = fuzzy_lines.line_report(documents(spark, texts, ids)).collect()
    kept = sorted(r["dedup_text"] for r in rows if r["doc_id"] == 1)
    assert [len(t.split("\n")) for t in kept] in ([1, 2], [2, 1]) and "unique line B" in "\n".join(kept) and "another line C" in "\n".join(kept)
    assert "\n".join(kept).count("first line here") == 1
    assert [r["dedup_text"] for r in rows if r["doc_id"] is None] == ["first line here"] and [r["dedup_text"] for r in rows if r["doc_id"] == 2] == [""]


def test_columns_named_as_helpers_stay(spark):
    docs = documents(spark, ["one line of words\nown", "one line of words"])
    for name in ("_kept", "_lines", "doc", "lines", "kept", "row", "place", "places", "key", "rejoined"):
        docs = docs.withColumn(name, F.lit(7))
    got = fuzzy_lines.deduplicate(docs)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["text"] == "" and rows[0]["n_chars"] == 21 and all(rows[0][n] == 7 for n in ("_kept", "_lines", "doc", "kept", "row"))


def test_repeated_rows_count_as_one_document(spark):
    texts, ids = ["same line of text\nsame line of text"] * 3, [5, 5, 6]
    rows = fuzzy_lines.line_report(documents(spark, texts, ids)).collect()
    assert sorted((r["doc_id"], r["dedup_text"]) for r in rows) == [(5, "same line of text")] * 2 + [(6, "")]


def plain_lines(texts, similarity=0.8):
    """Kept lines of documents 0, 1, ... by looking at all pairs of lines."""
    places = [(d, p, line) for d, t in enumerate(texts) for p, line in enumerate(t.split("\n")) if line.strip()]
    sets = [{low[k:k + 5] for k in range(max(1, len(low) - 4))} for low in (line.lower() for _, _, line in places)]
    root = list(range(len(places)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(places)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    gone = {places[k][:2] for k in range(len(places)) if find(k) != k}
    return ["\n".join(line for p, line in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in enumerate(texts)]


def test_lines_match_brute_force(spark):
    """Edits far from the limit, where banding finds all: small ones near 1, large ones well below 0.8."""
    draw, texts = random.Random(12), []
    for k in range(25):
        lines = [prose(100 + draw.randrange(12), 30) for _ in range(4)] + ["menu", "", "a longer line about something else"]
        lines.append(prose(100 + draw.randrange(12), 30) + draw.choice(["", "s", " x", " 🙂"]))
        texts.append("\n".join(draw.sample(lines, len(lines))))
    rows = {r["doc_id"]: r["dedup_text"] for r in fuzzy_lines.line_report(documents(spark, texts), min_chars=1).collect()}
    assert [rows[k] for k in range(len(texts))] == plain_lines(texts)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 9, 10, 99, 100, 101])
def test_secret_spans_in_blocks_equal_python(spark, n):
    """Any number of matches, some too short to count, with code points beyond 16 bits between them."""
    rng = random.Random(n)
    words = [rng.choice(["token=" + "a" * rng.randrange(10, 15), "AKIA" + "B" * rng.randrange(12, 17), "0f" * rng.randrange(6, 12)]) for _ in range(n)]
    text = "".join(w + rng.choice([" ", " 😀 ", "\n--\n"]) for w in words)
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    want = sorted(
        (m.start(), rank, kind, m.end())
        for rank, (kind, pattern, group, least) in enumerate(secrets.RULES["base-1"])
        for m in re.finditer(pattern, text) if len(m.group(group)) >= least
    )
    assert got[1].spans == ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
    assert got[2].spans == got[3].spans == ""


def test_many_secrets_of_one_text(spark):
    """100,000 spans in one text: places by arithmetic, and time that does not grow with the square."""
    word = "0123456789abcdef"
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(word + " "), 100_000).alias("text"))
    begin = time.monotonic()
    row = secrets.report(docs).first()
    assert time.monotonic() - begin < 60
    assert row.n_hex == 100_000 and (row.n_assign, row.n_access) == (0, 0)
    spans = row.spans.split(",")
    assert spans == [f"hex:{17 * i}:{17 * i + 16}" for i in range(100_000)]
