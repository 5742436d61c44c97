"""Keys of lines: alike lines share one, others hardly ever; texts are not kept."""

from __future__ import annotations

import os
import random

from test_operators import documents, prose
from voltlake.llm import common, fuzzy_lines


def jaccard(a, b):
    return len(a & b) / len(a | b)


def windows(line):
    low = line.lower()
    return {low[k:k + 5] for k in range(max(1, len(low) - 4))}


def test_lines_of_common_windows_share_few_keys(spark):
    """Lines of the same words in other orders share many windows, and hardly any run of hashes."""
    draw = random.Random(5)
    words = prose(1, 60).split()
    lines = [" ".join(draw.choices(words, k=30)) for _ in range(300)]
    frame = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "id long, line string")
    signed = {r["id"]: r for r in fuzzy_lines._signed(frame).collect()}
    assert all(signed[k]["n"] == len(windows(lines[k])) and len(signed[k]["keys"]) <= fuzzy_lines.STARTS for k in signed)
    shared = sum(bool(set(signed[a]["keys"]) & set(signed[b]["keys"])) for a in signed for b in range(a))
    assert shared < 0.02 * len(lines) ** 2 / 2


def test_lines_of_both_kinds_of_keys_meet(spark):
    """On either side of ``LONG`` shingles: a line and the same one with some characters more."""
    draw, texts, pairs = random.Random(8), [], 0
    for n in range(52, 84):
        line = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 1)) + "x"
        texts += [line, line + "".join(draw.choice("ABCDEF") for _ in range(n // 8))]
        assert jaccard(windows(texts[-2]), windows(texts[-1])) >= 0.8
    rows = {r["doc_id"]: r["n_dropped"] for r in fuzzy_lines.line_report(documents(spark, texts)).collect()}
    assert [rows[k] for k in range(len(texts))] == [0, 1] * (len(texts) // 2)


def test_texts_of_lines_without_a_key_in_common_are_not_written(spark, monkeypatch):
    written, real = {}, fuzzy_lines.stored

    def stored(frame, name):
        written[name] = real(frame, name)
        if name == "line-texts":
            written["texts"] = written[name].count()
        return written[name]

    monkeypatch.setattr(fuzzy_lines, "stored", stored)
    texts = [prose(k, 40) for k in range(50)] + [prose(0, 40) + " end"]
    folder = common.shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = {r["doc_id"]: r["n_dropped"] for r in fuzzy_lines.line_report(documents(spark, texts)).collect()}
    assert rows == {k: int(k == 50) for k in range(51)}
    assert "line" not in written["line-signatures"].columns and written["texts"] < 10
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert not left & {"line-texts", "line-signatures", "line-pairs", "line-buckets", "line-parities"}
