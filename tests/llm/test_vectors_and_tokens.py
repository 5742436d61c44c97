"""Centroids, hard negatives and token prefixes against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltlake.llm import centroids, hard_negatives, token_prefixes, vectors

VECTORS = "vec_id long, embedding array<float>, label int, id string, v int, cluster string, angles int"
NAN, INF = float("nan"), float("inf")


def embeddings(spark, rows):
    """Rows (key, vector, label) with extra columns whose names operators use inside."""
    return spark.createDataFrame([(k, v, label, "x", 1, "y", 2) for k, v, label in rows], VECTORS)


def drawn(seed, n, dims, labels=4, ties=False):
    draw = random.Random(seed)
    one = (lambda: draw.choice((-0.25, 0.0, 0.125, 0.5))) if ties else (lambda: draw.gauss(0, 0.3))
    return [(k, [one() for _ in range(dims)], draw.randrange(labels)) for k in range(n)]


ODD = [
    (900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0], 1), (903, [NAN, 0.0, 0.0, 0.0], 1), (904, [INF, 0.0, 0.0, 0.0], 1),
    (905, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5, 0.5], 1), (906, [0.0, 0.0, 0.0, 0.0], None), (907, [0.0, 0.0, 0.0, 0.0], 2),
    (5, [0.1, 0.2, 0.3, 0.4], 0), (5, [0.1, 0.2, 0.3, 0.4], 0),
]


def whole(v, scale=256):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def plain_clusters(rows, k, rounds, dims, seed="2:"):
    kept = [(key, whole(v)) for key, v, _ in rows if finite(v) and len(v) == dims]
    first = sorted((hashlib.sha256(f"{seed}{key}".encode()).hexdigest(), v) for key, v in kept if key is not None)[:k]
    now = [v for _, v in first] or [[0] * dims]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(now)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(now)):
            own = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if own:
                now[n] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    inertia = {n: sum(d for d, m in found if m == n) for n in range(len(now))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return [(key, n, d, inertia[n], sum(inertia.values()), digest[n]) for (key, _), (d, n) in zip(kept, found)]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("rows, k", [
    (drawn(1, 300, 4), 12), (drawn(2, 200, 4, ties=True), 9), (drawn(3, 60, 4) + ODD, 7), (drawn(4, 5, 4), 40), ([], 3),
    ([(None, [0.1, 0.2, 0.3, 0.4], 1)], 3), ([(k, [0.5, 0.5, 0.5, 0.5], 1) for k in range(50)], 4),
])
def test_clusters_match_brute_force(spark, rows, k):
    got = centroids.cluster(embeddings(spark, rows), centroids=k, rounds=3, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert in_order(map(tuple, got.collect())) == in_order(plain_clusters(rows, k, 3, 4))


def test_search_rejects_and_is_exact():
    draw = np.random.default_rng(7)
    middles = draw.integers(-3000, 3000, (40, 16))
    rows = middles[draw.integers(0, 40, 2000)] + draw.integers(-40, 40, (2000, 16))
    label, distance, measured = centroids.Nearest(middles)(rows)
    every = ((rows[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (label == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.2 * every.size


def test_roots_are_exact():
    squares = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1, (1 << 61) - 1])
    assert vectors.root(squares).tolist() == [math.isqrt(int(s)) for s in squares]


def test_components_out_of_range_are_an_error(spark):
    with pytest.raises(Exception, match="64 bits"):
        centroids.cluster(embeddings(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)]), dims=4).collect()


def plain_negatives(rows, every=5, positives=5, negatives=3):
    dims = max([len(v) for _, v, _ in rows if v] + [1])
    kept = {
        (key, label, tuple(whole(v) + [0] * (dims - len(v)))) for key, v, label in rows if finite(v) and key is not None and label is not None
    }
    out = []
    for key, label, v in kept:
        if key % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), other, m) for other, m, w in kept if other != key)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            good = [(s, n) for s, n, m in scored if m != label and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(key, positive, rank, n, -p, -s) for rank, (s, n) in enumerate(good, 1)]
    return sorted(out)


@pytest.mark.parametrize("rows", [
    drawn(11, 400, 6), drawn(12, 300, 3, ties=True), drawn(13, 100, 4) + ODD, drawn(14, 60, 4, labels=1), [], ODD,
    [(k, [0.5, 0.25], k % 2) for k in range(80)], [(k, [0.5 * (1 + k % 3), 0.25, 0.125 * (k % 5)][: 1 + k % 3], k % 3) for k in range(90)],
])
def test_hard_negatives_match_brute_force(spark, rows):
    got = hard_negatives.mine(embeddings(spark, rows), every=5)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_hard_negatives_in_small_blocks_are_the_same(spark):
    rows = drawn(15, 300, 5)
    got = hard_negatives.mine(embeddings(spark, rows), every=5, anchor_block=7)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)


def test_score_bounds_hold_and_skip():
    draw = np.random.default_rng(3)
    middles = draw.normal(0, 1, (12, 24))
    rows = np.floor(256 * (middles[np.sort(draw.integers(0, 12, 3000))] + draw.normal(0, 0.08, (3000, 24)))).astype(np.int64)
    directions = hard_negatives.references(rows[::7])
    angles = hard_negatives.angles_to(rows, directions)
    labels, ids = np.zeros(3000, np.int64), np.arange(3000)
    anchors = hard_negatives.Anchors(ids[:100], labels[:100], rows[:100], angles[:100])
    search = hard_negatives.Search(anchors, np.full((100, 1), -hard_negatives.OPEN), np.full((100, 1), hard_negatives.OPEN), True, 5)
    for k in range(0, 3000, 250):
        search.add(ids[k:k + 250], labels[k:k + 250], rows[k:k + 250], angles[k:k + 250])
    every = rows[:100] @ rows.T
    every[ids[:100], ids[:100]] = -(1 << 60)
    assert (search.score[:, 0] == -np.sort(-every, axis=1)[:, :5]).all()
    assert search.scored < 0.3 * search.pairs


@pytest.fixture(scope="module")
def model():
    return token_prefixes.ByteBpe(token_prefixes.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(token_prefixes.VOCABULARY))


PARTS = ["'", "r", "e", "v", "l", "s", " ", "  ", "\n", "　", "\x85", "\x1c", "aB", "123", "!", "..", "é", "日本", "🙂", "<|endoftext|>", "<|end", " hello", "՘", "\U00010940"]


def lengths(library, text):
    return [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]


def test_prefix_counts_are_the_library_s(model, library):
    draw = random.Random(5)
    texts = ["", "don't  we'll they've 're '", "<|endoftext|><|endoftext|>  x", "\n \n x\t\t", "=" * 300, "日本語テキスト 한국어 🙂🙂 é́"]
    texts += ["".join(draw.choice(PARTS) for _ in range(draw.randint(1, 25))) for _ in range(400)]
    for text in texts:
        assert model.counts(text).tolist() == lengths(library, text), text


def test_pairs_fit_as_merging_says(model):
    draw = random.Random(6)
    ids = list(model.texts)
    for _ in range(20_000):
        a, b = draw.choice(ids), draw.choice(ids)
        if model._fit(-1, a) and model._fit(-1, b):
            assert model._fit(a, b) == (model._merged(model.texts[a] + model.texts[b]) == [model.texts[a], model.texts[b]])


def test_clear_characters_are_cut_alike(model):
    import regex

    draw = random.Random(7)
    points = [chr(p) for p in [*range(0xD800), *range(0xE000, 0x30000)] if not regex.match(token_prefixes.DOUBTFUL, chr(p))]
    for k in range(0, len(points), 200):
        text = "".join(f"a{c}1{c}  x" for c in points[k:k + 200]) if draw.random() < 0.3 else "".join(points[k:k + 200])
        assert model.cut(text) == [text[b:e] for _, (b, e) in model.library.pre_tokenize_str(text)]


def test_long_pieces_are_counted_in_one_pass(model, library):
    for text in ("a" * 200_003, "".join(random.Random(8).choice("abcdefgh") for _ in range(100_000)), " " * 50_000 + "x", "x y " * 60_000):
        assert model.counts(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_budgets(spark, library):
    texts = [None, "", "one two three", "one two three", "  \n", "é日🙂" * 30, "hello world " * 500, "<|endoftext|> x"]
    docs = spark.createDataFrame([(k, t, 1, [2], "y") for k, t in enumerate(texts)] + [(None, "null key", 1, [2], "y")],
                                 "doc_id long, text string, n_tokens int, prefix_tokens array<int>, cut_chars string")
    got = {r["doc_id"]: r for r in token_prefixes.report(docs, limit=20).collect()}
    assert len(got) == 9
    for k, text in enumerate(texts):
        all_lengths = lengths(library, (text or "")[:400]) if len(text or "") < 400 else lengths(library, text)[: len(text) + 1]
        row = got[k]
        assert row["n_bytes"] == len((text or "").encode()) and row["n_tokens"] == all_lengths[-1]
        assert row["over_limit"] == (all_lengths[-1] > 20) and row["cut_chars"] == max(i for i, n in enumerate(all_lengths) if n <= 20)
    prefixes = token_prefixes.prefix_counts(docs)
    cut = token_prefixes.truncated(prefixes, 20).where("doc_id = 6").first()
    assert cut["text"] == texts[6][: got[6]["cut_chars"]] and len(cut["prefix_tokens"]) == len(cut["text"])
    assert token_prefixes.tokens_of_first(prefixes, 7).where("doc_id = 2").first()["first_tokens"] == lengths(library, "one two")[-1]
    assert token_prefixes.report(docs.where(F.lit(False))).count() == 0
