"""Cases that an operator once left out: each failed before its operator did the whole job."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from test_operators import documents, prose
from voltlake.llm import fuzzy_lines, html_layout, queries, sentencepiece_lattice


def windows(line):
    line = line.lower()
    return {line[k:k + 5] for k in range(max(1, len(line) - 4))}


def alike(a, b):
    a, b = windows(a), windows(b)
    return len(a & b) >= 0.8 * len(a | b)


def test_line_recall_over_character_windows(spark):
    draw, texts = random.Random(4), []
    for k in range(600):
        words = prose(k, draw.randint(8, 40)).split()
        texts.append(" ".join(words))
        words[draw.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    pairs = [k + 1 for k in range(0, len(texts), 2) if alike(texts[k], texts[k + 1])]
    rows = {r["doc_id"]: r["n_dropped"] for r in fuzzy_lines.line_report(documents(spark, texts)).collect()}
    assert len(pairs) > 400 and sum(rows[k] for k in pairs) >= 0.97 * len(pairs)
    assert not any(rows[k] for k in range(len(texts)) if k not in set(pairs))


def test_lines_are_compared_to_their_last_character(spark):
    texts = [
        "https://www.example.com/a-page-of-one-kind", "https://www.example.com/quite-another-subject", "漢字仮名交じり文" * 4,
        "漢字仮名交じり文" + "".join(chr(0x4e00 + 7 * k) for k in range(40)), "one two " + "x" * 25 + "abcdefghijklmnopqrst",
        "one two " + "x" * 25 + "0123456789987654321",
    ]
    rows = fuzzy_lines.line_report(documents(spark, texts)).collect()
    assert not any(r["n_dropped"] for r in rows)


def test_short_lines_take_part(spark, monkeypatch):
    docs = documents(spark, ["Les.\nMenu\n\nown text", "Les.\n \nMenu\n\t\nother words"])
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    rows = {r["doc_id"]: r["dedup_text"] for r in queries.op9_fuzzy_lines(spark, "").collect()}
    assert rows == {0: "Les.\nMenu\n\nown text", 1: " \n\t\nother words"}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert kept == rows


def test_near_copies_beyond_three_bits_leave_the_pipeline(spark):
    draw, texts = random.Random(6), []
    for k in range(60):
        words = prose(k, 150).split()
        for edits in (0, 1, 2, 3, 5):
            own = list(words)
            for _ in range(edits):
                own[draw.randrange(150)] = f"new{draw.randrange(99)}"
            texts.append(" ".join(own))

    def shingles(text):
        words = text.split()
        return {tuple(words[k:k + 5]) for k in range(len(words) - 4)}

    sets = [shingles(t) for t in texts]
    close = [
        (a, b) for a in range(len(sets)) for b in range(a - a % 5, a)
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ]
    least = {n: n for n in range(len(texts))}
    for _ in range(5):
        for a, b in close:
            least[a] = least[b] = min(least[a], least[b])
    want = {n for n, low in least.items() if n == low}
    docs = documents(spark, texts)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == want and len(want) < 150


def test_all_that_a_table_holds_is_shown():
    page = html_layout.page_text
    assert page("<table><tbody>note<tr><td>a<td>b</table>") == "note\na  b"
    assert page("<table><tbody><form><tr><td>x<td>y</tr></form></tbody></table>z") == "x  y\n\nz"
    assert page("<table><thead><div>head</div><tr><td>a</table>") == "head\na"
    assert page("<table><tr><form><td>a</td><td>b</td></form></tr></table>") == "a  b"
    assert page("<table><tbody hidden>no<tr><td>no</tbody><tr><td>yes</table>") == "yes"


def test_svg_and_math_are_shown():
    page = html_layout.page_text
    assert page("<p>a <svg/>b<p>c <svg><path d=x /><text>label</text><text>two</text></svg>") == "a b\n\nc\nlabel\ntwo"
    assert page("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math>") == "x=1"
    assert page("<svg><defs><text>no</text></defs><title>no</title><style>no</style><text>yes</text></svg>after") == "yes\nafter"


@pytest.mark.parametrize("text", ["Hello there", "no no no no", "a\u2581b \u00e9a", "aaaa aaaa", "one"])
def test_nbest_segmentations_have_their_ids(spark, text):
    model = sentencepiece_lattice.piece_model(sentencepiece_lattice.DEFAULT_MODEL)
    every = [(0.0, ())]
    for unit in model.split(text):
        ends, found = model.edges(unit), []

        def walk(end, score, ids):
            if end == 0:
                found.append((score, ids))
            for start, own, part in ends[end - 1] if end else ():
                walk(start, score + own, part + ids)

        walk(len(unit), 0.0, ())
        every = sorted([(a + s, i + j) for a, i in every for s, j in found], reverse=True)[:200]
    price = {ids: score for score, ids in every}
    row = sentencepiece_lattice.encode_documents(documents(spark, [text]), nbest=5).select(
        "piece_ids", "nbest_scores", sentencepiece_lattice.nbest_ids().alias("all")).first()
    got = [tuple(ids) for ids in row["all"]]
    assert got[0] == tuple(row["piece_ids"]) and len(set(got)) == len(got) == len(row["nbest_scores"])
    assert [price[ids] for ids in got] == pytest.approx(row["nbest_scores"])
    assert row["nbest_scores"] == pytest.approx([s for s, _ in every[:5]])
    assert all(model.decode(ids) == text for ids in got)
