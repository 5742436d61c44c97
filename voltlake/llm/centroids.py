"""Centroid clustering in whole numbers; the nearest centroid is found by equal-average equal-variance search.

Centroids are sorted by the mean of their components. For each vector the search starts at its own mean and goes
outward, to the nearer mean first. With d components, means m and deviations s (times the root of d), the
squared distance is at least d times the squared difference of the means; once that is more than the best
distance so far the search is over. It is also at least that plus the squared difference of the deviations,
which rejects most of what is left. The others are measured in whole numbers. All inequalities are
evaluated in whole numbers, with roots rounded so that nothing nearer, nor as near, is ever rejected.

Each round is one pass over the stored vectors: tasks assign their vectors and hand on sums per centroid, Spark
adds them up, and the driver, which holds the centroids only, divides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, stored
from .vectors import block, complete, root, whole_numbers

CENTROIDS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED = "2:"


class Nearest:
    """Equal-average equal-variance search among centroids (a matrix of whole numbers, numbered by row)."""

    def __init__(self, centroids: np.ndarray) -> None:
        sums = centroids.sum(axis=1)
        self.number = np.argsort(sums, kind="stable")
        self.rows, self.sums = centroids[self.number], sums[self.number]
        self.spread = self._spread(self.rows, self.sums)

    @staticmethod
    def _spread(rows: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Deviation of the components times their number, rounded down."""
        return root(rows.shape[1] * np.einsum("ij,ij->i", rows, rows) - sums * sums)

    def __call__(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (ties: the smaller) and squared distance of each row; how many distances were measured."""
        (n, dims), count = rows.shape, len(self.number)
        sums = rows.sum(axis=1)
        spread = self._spread(rows, sums)
        after = np.searchsorted(self.sums, sums)
        before = after - 1
        best, label = np.full(n, -1, np.int64), np.full(n, count, np.int64)
        open_rows, measured = np.arange(n), 0
        far = np.iinfo(np.int64).max
        for _ in range(count):
            lo, hi = before[open_rows], after[open_rows]
            below = np.where(lo >= 0, sums[open_rows] - self.sums[lo], far)
            above = np.where(hi < count, self.sums[np.minimum(hi, count - 1)] - sums[open_rows], far)
            left = below <= above
            at, gap = np.where(left, lo, hi), np.minimum(below, above)
            before[open_rows[left]] -= 1
            after[open_rows[~left]] += 1
            known = best[open_rows]
            go = (known < 0) | (gap * gap <= dims * known)
            open_rows, at, gap, known = open_rows[go], at[go], gap[go], known[go]
            if not len(open_rows):
                break
            # both roots are rounded down, so their difference may be one too large
            apart = np.maximum(np.abs(spread[open_rows] - self.spread[at]) - 1, 0)
            near = (known < 0) | (gap * gap + apart * apart <= dims * known)
            who, at, known = open_rows[near], at[near], known[near]
            gaps = rows[who] - self.rows[at]
            distance = np.einsum("ij,ij->i", gaps, gaps)
            number = self.number[at]
            better = (known < 0) | (distance < known) | ((distance == known) & (number < label[who]))
            best[who[better]], label[who[better]] = distance[better], number[better]
            measured += len(who)
        return label, best, measured


def _partial_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each centroid that has vectors in this task: cluster, n, sums."""
    nearest = Nearest(centroids)
    sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
    for batch in batches:
        rows = block(batch.column(0), centroids.shape[1])
        label, _, _ = nearest(rows)
        np.add.at(sums, label, rows)
        counts += np.bincount(label, minlength=len(counts))
    used = np.flatnonzero(counts)
    if len(used):
        yield pa.record_batch({
            "cluster": pa.array(used, pa.int32()), "n": pa.array(counts[used]), "sums": pa.array(sums[used].tolist(), pa.list_(pa.int64())),
        })


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    nearest = Nearest(centroids)
    for batch in batches:
        label, distance, _ = nearest(block(batch.column(1), centroids.shape[1]))
        yield pa.record_batch({"id": batch.column(0), "cluster": pa.array(label.astype(np.int32)), "distance": pa.array(distance)})


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids of one round: the whole part of the mean of each one's vectors; one without vectors stays."""
    parts = rows.select("v").mapInArrow(lambda b: _partial_sums(b, centroids), "cluster int, n long, sums array<long>")
    sums = parts.select("cluster", "n", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total"))
    moved = centroids.copy()
    for r in sums.collect():  # a number for each centroid and component
        moved[r["cluster"], r["pos"]] = r["total"] // r["n"]
    return moved


def cluster(
    vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """Per kept vector: ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null, NaN or infinite; a component x counts as floor(``scale`` * x). The
    first centroids are the vectors with the least SHA-256 of ``seed`` and the key, in that order (equal keys: by
    components; a null key is never one of them); there are fewer if there are fewer vectors. Each of
    ``rounds`` rounds assigns every vector to its nearest centroid (ties: the smaller number) and moves each
    centroid that has vectors to the whole part of their mean; then all are assigned once more. Rows
    with null or repeated keys are vectors like any other and come back each. No kept vector: no row.
    A component whose product is 2^30 / ``dims`` or more is an error, as distances would leave 64 bits. Other
    columns are not read. The driver holds ``centroids`` vectors, tasks a batch of rows beside them.
    """
    kept = vectors.where(complete(vector) & (F.size(vector) == dims))
    rows = stored(kept.select(F.col(key).alias("id"), whole_numbers(vector, scale, (1 << 30) // dims).alias("v")), "vectors")
    hashed = rows.where("id IS NOT NULL").select(F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256).alias("hash"), "v")
    first = [r["v"] for r in hashed.orderBy("hash", "v").limit(centroids).collect()]
    # no row at all, or only rows without a key: the centroid is the zero vector
    now = np.array(first or [[0] * dims], np.int64)
    for _ in range(rounds):
        now = _moved(rows, now)
    kind = rows.schema["id"].dataType.simpleString()
    found = stored(rows.select("id", "v").mapInArrow(lambda b: _assigned(b, now), f"id {kind}, cluster int, distance long"), "clusters")
    free(rows)
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    total = sum(inertia.values())
    texts = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in now]
    about = vectors.sparkSession.createDataFrame(
        [(k, inertia.get(k, 0), total, text) for k, text in enumerate(texts)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(about), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256",
    )
