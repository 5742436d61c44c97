"""Hard negatives by exact inner products, with angular triangle filtering.

Every vector keeps its angles to a few reference directions. Angles obey the triangle inequality: the angle of two
vectors is at least the difference of their angles to a reference and at most their sum. The tightest of
these bounds over all references is an interval of the cosine; times both norms, and widened by more than all rounding
errors together, it bounds the score. Only pairs whose interval meets a window of scores that is still wanted
are scored, in whole numbers: for positives the window is open above the anchor's least kept score, for
negatives it lies between two shares of the positive's score, and above the least kept score in it. The same test
with the ranges of a whole batch of vectors skips the batch; vectors are sorted so that batches are narrow.

Anchors are a stated set of queries. They meet all vectors in blocks: a bounded block of anchors goes to all tasks,
each goes through its stored vectors once and hands on the best few of each window, and Spark keeps
the best of those. References come from a bounded sample; they change what is skipped, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, stored
from .vectors import block, complete, whole_numbers

SCALE = 256
REFERENCES = 16
SAMPLE_ROWS = 2_048
ANCHOR_BLOCK = 16_384
ANCHORS_AT_ONCE = 256
ROWS_AT_ONCE = 2_048

#: More than the errors of two stored angles (32-bit) and of their arc cosines, in radians; and relative to the norms.
ANGLE_SLACK = 1e-5
SCORE_SLACK = 1e-12
NONE = np.iinfo(np.int64).min
OPEN = 1 << 62


@dataclass
class Anchors:
    ids: np.ndarray
    labels: np.ndarray
    rows: np.ndarray
    angles: np.ndarray

    @property
    def norms(self) -> np.ndarray:
        return _norms(self.rows)


def _norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows).astype(np.float64))


def references(sample: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Unit directions from a sample, each far from those before it."""
    rows = sample[np.any(sample != 0, axis=1)].astype(np.float64)
    if not len(rows):
        return np.eye(1, sample.shape[1])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    chosen, nearest = [0], rows @ rows[0]
    while len(chosen) < min(count, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def angles_to(rows: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of vectors to directions; of a zero vector, whose scores are all 0, no matter which."""
    norms = np.maximum(_norms(rows), 1.0)
    return np.arccos(np.clip((rows.astype(np.float64) @ directions.T) / norms[:, None], -1, 1)).astype(np.float32)


def score_bounds(least: np.ndarray, most: np.ndarray, norms_lo: np.ndarray, norms_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores from bounds of angles and of the product of the norms."""
    high = np.cos(np.maximum(least - ANGLE_SLACK, 0)) + SCORE_SLACK
    low = np.cos(np.minimum(most + ANGLE_SLACK, np.pi)) - SCORE_SLACK
    return low * np.where(low > 0, norms_lo, norms_hi) - 1, high * np.where(high > 0, norms_hi, norms_lo) + 1


def _scores(anchors: np.ndarray, rows: np.ndarray, i: np.ndarray, j: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of the pairs (i, j); with ``exact`` doubles hold them all."""
    if exact and len(i) * 16 > len(anchors) * len(rows):
        return (anchors.astype(np.float64) @ rows.T.astype(np.float64))[i, j].astype(np.int64)
    step = 1 << 16
    return np.concatenate([
        np.einsum("ij,ij->i", anchors[i[k:k + step]], rows[j[k:k + step]]) for k in range(0, len(i), step)
    ] or [np.zeros(0, np.int64)])


class Search:
    """The best ``keep`` scores of each anchor in each of its windows, over the batches seen so far."""

    def __init__(self, anchors: Anchors, low: np.ndarray, high: np.ndarray, same: bool, keep: int) -> None:
        self.anchors, self.low, self.high, self.same, self.keep = anchors, low, high, same, keep
        self.norms, self.angles = anchors.norms, anchors.angles.astype(np.float64)
        self.score = np.full((*low.shape, keep), NONE)
        self.id = np.full((*low.shape, keep), np.iinfo(np.int64).max)
        self.scored = self.pairs = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, angles: np.ndarray) -> None:
        for k in range(0, len(ids), ROWS_AT_ONCE):
            part = slice(k, k + ROWS_AT_ONCE)
            self._add(ids[part], labels[part], rows[part], angles[part].astype(np.float64))

    def _add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, angles: np.ndarray) -> None:
        norms = _norms(rows)
        floor = np.maximum(self.low, self.score[:, :, -1])
        floor, ceiling = np.where(self.low <= self.high, floor, OPEN).min(axis=1), self.high.max(axis=1)
        here = np.unique(labels)
        wanted = np.isin(self.anchors.labels, here) if self.same else ~((len(here) == 1) & (self.anchors.labels == here[0]))
        low, high = self._tile_bounds(norms, angles.min(axis=0), angles.max(axis=0))
        chosen = np.flatnonzero(wanted & (high >= floor) & (low <= ceiling))
        self.pairs += len(self.anchors.ids) * len(ids)
        exact = rows.shape[1] * float(max(np.abs(rows).max(initial=0), np.abs(self.anchors.rows).max(initial=0))) ** 2 < 2.0**53
        for k in range(0, len(chosen), ANCHORS_AT_ONCE):
            some = chosen[k:k + ANCHORS_AT_ONCE]
            apart, along = np.zeros((len(some), len(ids))), np.full((len(some), len(ids)), np.pi)
            for r in range(angles.shape[1]):
                own, other = self.angles[some, r, None], angles[None, :, r]
                np.maximum(apart, np.abs(own - other), out=apart)
                both = own + other
                np.minimum(along, np.minimum(both, 2 * np.pi - both), out=along)
            product = self.norms[some, None] * norms
            low, high = score_bounds(apart, along, product, product)
            alike = self.anchors.labels[some, None] == labels
            open_pairs = (high >= floor[some, None]) & (low <= ceiling[some, None]) & (alike == self.same)
            i, j = np.nonzero(open_pairs & (self.anchors.ids[some, None] != ids))
            score = _scores(self.anchors.rows[some], rows, i, j, exact)
            self.scored += len(i)
            self._keep(some[i], score, ids[j])

    def _tile_bounds(self, norms: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each anchor's scores with vectors whose angles and norms are in these ranges."""
        apart = np.maximum(np.maximum(self.angles - most, least - self.angles), 0).max(axis=1)
        along = np.minimum(self.angles + most, 2 * np.pi - self.angles - least).min(axis=1)
        return score_bounds(apart, along, self.norms * norms.min(), self.norms * norms.max())

    def _keep(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            good = (score >= np.maximum(self.low[anchor, w], self.score[anchor, w, -1])) & (score <= self.high[anchor, w])
            if not good.any():
                continue
            a, s, d = anchor[good], score[good], ids[good]
            touched = np.unique(a)
            old = self.score[touched, w].ravel()
            held = old != NONE
            a = np.concatenate([a, np.repeat(touched, self.keep)[held]])
            s, d = np.concatenate([s, old[held]]), np.concatenate([d, self.id[touched, w].ravel()[held]])
            order = np.lexsort((d, -s, a))
            a, s, d = a[order], s[order], d[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            top = place < self.keep
            self.score[a[top], w, place[top]], self.id[a[top], w, place[top]] = s[top], d[top]

    def found(self) -> pa.RecordBatch:
        a, w, place = np.nonzero(self.score != NONE)
        return pa.record_batch({
            "a": pa.array(a.astype(np.int32)), "w": pa.array(w.astype(np.int32)),
            "score": pa.array(self.score[a, w, place]), "id": pa.array(self.id[a, w, place]),
        })


def _searched(batches: Iterator[pa.RecordBatch], search: Search) -> Iterator[pa.RecordBatch]:
    dims, n = search.anchors.rows.shape[1], search.angles.shape[1]
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        angles = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        search.add(ids, labels, block(batch.column(2), dims), angles)
    yield search.found()


def _best(rows: DataFrame, search: Search) -> DataFrame:
    """(a, w, score, id, rank) of the best of all vectors in each window: highest score first, then smallest id."""
    found = rows.mapInArrow(lambda b: _searched(b, search), "a int, w int, score long, id long")
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.keep)


def _described(rows: DataFrame, dims: int, directions: np.ndarray) -> DataFrame:
    """Rows with their angles, sorted inside partitions by label, nearest reference and the angle to it."""
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = angles_to(block(batch.column(2), dims), directions)
            near = angles.argmin(axis=1)
            yield pa.record_batch({
                "id": batch.column(0), "label": batch.column(1), "v": batch.column(2), "angles": pa.array(list(angles), pa.list_(pa.float32())),
                "near": pa.array(near.astype(np.int32)), "angle": pa.array(angles[np.arange(len(near)), near]),
            })

    schema = "id long, label long, v array<int>, angles array<float>, near int, angle float"
    return rows.mapInArrow(describe, schema).sortWithinPartitions("label", "near", "angle").select("id", "label", "v", "angles")


def _windows(scores: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole scores from ``low`` to ``high`` hundredths of each positive's; empty where that is none, or no positive."""
    known = scores != NONE
    safe = np.where(known, scores, 0)
    return np.where(known, -(-safe * low // 100), 1), np.where(known, safe * high // 100, 0)


def mine(
    vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE,
    key: str = "vec_id", label: str = "label", vector: str = "embedding", anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest negatives that are not too hard.

    Anchors are the rows whose ``key`` is divisible by ``every``. A score is the inner product of two vectors of whole numbers
    floor(``scale`` * x); higher scores come first, ties by smaller key. An anchor's positives are its first
    ``positives`` other rows of the same label; for each, the first ``negatives`` rows of other labels whose score is
    from ``low`` to ``high`` hundredths of the positive's come back, ranked from 1. A positive without such
    rows, and an anchor without positives, gives no row.

    Rows with a null key, label or vector, or a null, NaN or infinite component, take no part. Shorter vectors count as if
    they ended in zeros. Rows equal in key, label and vector count once; rows that share a key only are
    separate, but no row is its own key's positive or negative. Other columns are not read; no rows, no result. Components
    are bounded so that scores times 100 stay within 64 bits; larger ones are an error.

    At a time, ``anchor_block`` anchors and their positives (on average, by hash) are held by the driver and each task.
    """
    spark = vectors.sparkSession
    kept = vectors.where(complete(vector) & F.col(key).isNotNull() & F.col(label).isNotNull())
    dims = max(1, kept.agg(F.max(F.size(vector))).first()[0] or 1)
    most = int((2**55 / dims) ** 0.5)
    rows = kept.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), whole_numbers(vector, scale, most).alias("v"),
    ).dropDuplicates()
    sample = rows.orderBy(F.xxhash64("id"), "id", "label", "v").limit(SAMPLE_ROWS).select("v").toArrow()
    directions = references(block(sample.column("v").combine_chunks(), dims) if sample.num_rows else np.zeros((0, dims), np.int64))
    rows = stored(_described(rows, dims, directions), "angles")
    anchors = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-anchors.count() // anchor_block))
    anchors = stored(anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks)).cast("int")), "anchors")
    results = []
    for k in range(blocks):
        own = anchors.where(F.col("block") == k).select("id", "label", "v", "angles").toArrow().combine_chunks()
        if own.num_rows:
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in own.columns]
            block_of = Anchors(
                columns[0].to_numpy(), columns[1].to_numpy(), block(columns[2], dims),
                columns[3].flatten().to_numpy().reshape(-1, len(directions)),
            )
            results.append(stored(_mined(rows, block_of, positives, negatives, low, high), "negatives"))
    free(rows, anchors)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = results[0] if results else spark.createDataFrame([], schema)
    for more in results[1:]:
        found = found.unionByName(more)
    return found


def _mined(rows: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    n = len(anchors.ids)
    everything = np.full((n, 1), -OPEN), np.full((n, 1), OPEN)
    score, id = np.full((n, positives), NONE), np.zeros((n, positives), np.int64)
    for r in _best(rows, Search(anchors, *everything, same=True, keep=positives)).collect():
        score[r["a"], r["rank"] - 1], id[r["a"], r["rank"] - 1] = r["score"], r["id"]
    found = _best(rows, Search(anchors, *_windows(score, low, high), same=False, keep=negatives))
    a, w = np.nonzero(score != NONE)
    pairs = rows.sparkSession.createDataFrame(pa.table({
        "a": a.astype(np.int32), "w": w.astype(np.int32), "anchor_id": anchors.ids[a], "positive_id": id[a, w], "positive_score": score[a, w],
    }))
    # as many pairs as the block has anchors, times positives
    return found.join(F.broadcast(pairs), ["a", "w"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
