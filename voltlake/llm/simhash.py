"""SimHash fingerprints and their links within a few bits, found by the generalised pigeonhole principle.

A pair within ``radius`` bits must, for any split of the 64 bits into m parts and any thresholds t_i with
sum t_i = radius - m + 1, agree within t_i bits on at least one part (t_i = -1: the part is not used).
``plan_parts`` groups correlated bits into parts on a bounded sample of fingerprints and allocates the
thresholds by dynamic programming on estimated candidate counts; ``links`` probes every fingerprint's
t_i-neighbours of part i by an equi-join and verifies all 64 bits.

``near_copies`` finds texts of a wanted Jaccard likeness: the texts' fingerprints are linked as above, and
the whole shingle sets of each link are compared. Such texts are often 4 to 11 bits apart, where the probes of 64 bits meet a
share of all pairs; so what the links have not joined is then looked for by each set's rarest shingles, which no
two such sets can both avoid, and verified alike. It misses no pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_candidates, collect_garbage, component_sizes, components, free, small_side, stored

BITS = 64
PRINT_WIDTH = 3
COPY_WIDTH = 5
COPY_SIMILARITY = 0.8


def _digests(text: str, width: int) -> bytes:
    """The 64-bit hashes of all ``width``-word shingles in turn; of all words if they are fewer; none without a word."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return digest(joined, 42) if words else b""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[width - 1:]
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts[: len(ends)].tolist(), ends.tolist())])


def fingerprint_bytes(text: str, width: int) -> int:
    """SimHash of one text: a bit is 1 if it is set in over half of the hashed ``width``-word shingles."""
    raw = _digests(text, width)
    n, total = len(raw) // 8, np.zeros(BITS, np.int64)
    hashes = np.frombuffer(raw, np.uint8).reshape(n, 8)
    for at in range(0, n, 65_536):
        total += np.unpackbits(hashes[at:at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def shingle_set(text: str, width: int) -> np.ndarray:
    """The hashes of the distinct ``width``-word shingles of one text, in order."""
    return np.unique(np.frombuffer(_digests(text, width), np.int64))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = PRINT_WIDTH) -> DataFrame:
    """``key`` and ``fp`` (the 64 bits as a signed long) of every whole text.

    A-Z is lowered; words are runs of other characters than space and tab to carriage return; shingles
    are counted with repeats. Null and word-free texts get 0; a text of fewer words than ``width`` is one
    shingle. Rows stream through Arrow one record batch at a time; nothing is shuffled.
    """
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint_bytes(value.as_py() or "", width) for value in batch.column(1)]
            signed = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Part:
    """Some of the 64 bits, and how many of them a probe may flip (-1: unused)."""

    bits: tuple[int, ...]
    threshold: int

    def probes(self) -> list[int]:
        """Masks (within the part's own bits, moved together) of all flips up to the threshold."""
        return [
            sum(1 << b for b in flip)
            for size in range(self.threshold + 1)
            for flip in combinations(range(len(self.bits)), size)
        ]


def plan_parts(sample: np.ndarray, rows: int, radius: int, max_parts: int = 4) -> list[Part]:
    """The split and the thresholds with the least estimated work for ``rows`` distinct fingerprints.

    Work is the number of probes and index entries plus the expected candidates. The share of pairs
    within t bits of each other on a part is counted over all pairs of the ``sample`` (at most a few
    thousand fingerprints) and smoothed by the value for independent even bits, so it is never zero.
    For each number of parts the thresholds come from a dynamic programme over the parts.
    """
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    best: tuple[float, list[Part]] | None = None
    for m in range(1, min(max_parts, radius + 1) + 1):
        groups = _correlated_groups(bits, m)
        budget = radius - m + 1
        costs = [_part_costs(bits[:, list(g)], rows, budget) for g in groups]
        cost, thresholds = _allocate(costs, budget)
        if best is None or cost < best[0]:
            best = cost, [Part(g, t) for g, t in zip(groups, thresholds)]
    return best[1]


def _correlated_groups(bits: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m groups of nearly equal size; each grows by the free bit most correlated with it."""
    if len(bits) > 1:
        centred = bits - bits.mean(axis=0)
        spread = np.maximum(centred.std(axis=0), 1e-6)
        likeness = np.abs(centred.T @ centred / len(bits) / np.outer(spread, spread))
    else:
        likeness = np.eye(BITS)
    np.fill_diagonal(likeness, 0)
    free, groups = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        group = [max(free, key=lambda b: (likeness[b, list(free)].max(), -b))]
        free.remove(group[0])
        while len(group) < size:
            nearest = max(free, key=lambda b: (likeness[b, group].mean(), -b))
            group.append(nearest)
            free.remove(nearest)
        groups.append(tuple(sorted(group)))
    return groups


def _part_costs(bits: np.ndarray, rows: int, budget: int) -> list[float]:
    """Estimated work of thresholds -1, 0, ... budget on one part."""
    n, width = bits.shape
    counts = np.zeros(width + 1)
    for at in range(0, n, 512):
        block = bits[at:at + 512]
        apart = (block @ (1 - bits).T + (1 - block) @ bits.T).round().astype(np.int64)
        counts += np.bincount(apart.ravel(), minlength=width + 1)
    counts[0] -= n  # each row with itself
    pairs = max(1.0, float(n) * (n - 1))
    costs, probes, even = [0.0], 0, 0.0
    for t in range(budget + 1):
        probes += comb(width, t) if t <= width else 0
        even += (comb(width, t) if t <= width else 0) / 2.0**width
        share = max(counts[: t + 1].sum() / pairs, even)
        costs.append(rows * (1.0 + probes) + float(rows) * rows / 2 * share)
    return costs


def _allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum ``budget``, each at least -1."""
    state: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in state.items():
            for t in range(-1, budget + 1):
                at = used + t
                if at not in new or cost + part[t + 1] < new[at][0]:
                    if t + 1 < len(part):
                        new[at] = cost + part[t + 1], [*chosen, t]
        state = new
    return state[budget]


def _moved_together(fp: Column, bits: tuple[int, ...]) -> Column:
    """The part's bits as one number. Runs of neighbouring bits move with one shift."""
    runs: list[list[int]] = []
    for b in bits:
        if runs and runs[-1][-1] == b - 1:
            runs[-1].append(b)
        else:
            runs.append([b])
    value, at = F.lit(0).cast("long"), 0
    for run in runs:
        mask = (1 << len(run)) - 1
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        piece = F.shiftrightunsigned(fp, run[0]).bitwiseAND(F.lit(mask).cast("long"))
        value, at = value.bitwiseOR(F.shiftleft(piece, at)), at + len(run)
    return value


def links(prints: DataFrame, radius: int = 3, sample_rows: int = 3000) -> DataFrame:
    """Pairs (u, v), u < v, of distinct fingerprints (column fp) that connect all those within ``radius`` bits.

    Every pair within the radius ends in one component; not every pair is listed, since a dense group
    would list its square. First, fingerprints whose one-bit neighbourhoods meet (two bits apart or
    less) link to the least member of the meeting point: 65 keys a row and an aggregate, exact, and
    linear for any density. Then probes find candidates, and within a bucket only pairs of different
    first-step components are compared, of which the largest is never compared with itself.
    ``sample_rows`` bounds what the planning sees.
    """
    prints = prints.select("fp").where(F.col("fp").isNotNull()).distinct()
    rows = prints.count()
    none = prints.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    if rows < 2 or radius < 0:
        return none
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).toPandas()["fp"].to_numpy()
    parts = plan_parts(sample.view(np.uint64), rows, radius)
    close = none
    known = prints.select("fp", F.col("fp").alias("component"), F.lit(1).cast("long").alias("size"))
    if radius >= 2:
        close = stored(_meeting_links(prints), "simhash-close")
        found = component_sizes(components(close, "simhash-close")).withColumnRenamed("node", "fp")
        known = prints.join(found, "fp", "left").select(
            "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("size", F.lit(1)).alias("size"),
        )
    known = stored(known, "simhash-known")
    entries = [_entries(known, number, part) for number, part in enumerate(parts) if part.threshold >= 0]
    index = entries[0]
    for more in entries[1:]:
        index = index.unionByName(more)
    order = F.shiftleft("size", 20).bitwiseOR(F.xxhash64("component").bitwiseAND(F.lit((1 << 20) - 1)))
    mixed = (
        index.groupBy("part", "value")
        .agg(F.max_by("component", order).alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        .where("lo < hi")
        .drop("lo", "hi")
    )
    index = index.join(mixed, ["part", "value"])
    probe = index.where("component != main").select(
        "part", "value", "main", F.col("fp").alias("a"), F.col("component").alias("ca"), F.col("exact").alias("ea"),
    )
    base = index.select(
        "part", "value", F.col("fp").alias("b"), F.col("component").alias("cb"), F.col("exact").alias("eb"),
    )
    pairs = probe.join(base, ["part", "value"]).where(
        (F.col("ca") != F.col("cb"))
        & (F.col("ea") | F.col("eb"))
        & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b")))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    )
    return close.unionByName(pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))).distinct()


def _meeting_links(prints: DataFrame) -> DataFrame:
    """Each fingerprint and the least one that reaches the same point by at most one flip (so within two bits)."""
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(BITS)])
    points = prints.select("fp", F.explode(flips).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"),
    )
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("hi")).where("v < hi").drop("hi")
    # a point that only one fingerprint reaches is gone here, so little is joined
    return points.join(least, "point").where("fp != v").select(F.col("fp").alias("u"), "v").distinct()


def _entries(known: DataFrame, number: int, part: Part) -> DataFrame:
    """Bucket entries of one part: the exact value, and each value a probe may flip to."""
    masks = F.array(*[F.lit(mask).cast("long") for mask in part.probes()])
    return known.select(
        "fp", "component", "size", _moved_together(F.col("fp"), part.bits).alias("own"), F.explode(masks).alias("mask"),
    ).select(
        F.lit(number).alias("part"), F.col("own").bitwiseXOR(F.col("mask")).alias("value"),
        "fp", "component", "size", (F.col("mask") == 0).alias("exact"),
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, radius: int = 3,
) -> DataFrame:
    """Per row of ``docs``: ``key``, fingerprint (16 hex digits) and component_id, the smallest ``key`` reachable.

    Rows link when their fingerprints differ in ``radius`` bits or less. Copies share a fingerprint, so
    only distinct fingerprints are linked; the join back to the rows is on the fingerprint, and AQE splits
    one that a large share of the rows has. Repeated rows come back repeated; an empty table gives none.
    """
    prints = stored(fingerprints(docs, text, key, width), "simhash-prints")
    classes = prints.groupBy("fp").agg(F.min(key).alias("least"))
    found = components(links(classes, radius), "simhash-links")
    roots = found.join(classes, found.node == classes.fp).groupBy("component").agg(F.min("least").alias("reach"))
    linked = found.join(roots, "component").select(F.col("node").alias("fp"), "reach")
    classes = classes.join(linked, "fp", "left").select("fp", F.coalesce("reach", "least").alias("component_id"))
    return prints.join(classes, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def _shingle_sets(docs: DataFrame, text: str, width: int) -> DataFrame:
    """id (hash of the set) and members of the shingle set of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                sets = [shingle_set(value.as_py() or "", width) for value in batch.column(0).slice(at, 500)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_id(own) for own in sets], pa.int64()), _lists(sets)], names=["id", "members"])

    return docs.select(text).mapInArrow(run, "id long, members array<long>")


def _set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), 42)).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(own) for own in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _common_shingles(docs: DataFrame, text: str, key: str, width: int, sample_rows: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several rows of a sample have (at most ``most``, in order of their hashes), and in how many.

    They come last in the order of rarity. Any order finds every pair; the sample only spares comparisons.
    """
    share = max(1, docs.count() // sample_rows)
    seen = _shingle_sets(docs.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0), text, width)
    counts = seen.select(F.explode("members").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    found = counts.where("n > 1").orderBy(F.desc("n"), "shingle").limit(most).toPandas().sort_values("shingle")
    return found["shingle"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _rare_first(own: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(common) or not len(own):
        return own
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    return own[np.lexsort((own, np.where(common[at] == own, counts[at], 0)))]


def set_parity(own: np.ndarray) -> np.ndarray:
    """The words of 64 bits of a set's bitmap, in which each member flips one bit: a power of two of bits, as many as members or more.

    Two sets differ in at least as many members as their bitmaps differ in bits, and of bitmaps of different lengths the
    longer one folds (by exclusive or of its parts) to what it would be in the shorter length.
    """
    bits = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount(own & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _bits_apart(a: Column, b: Column) -> Column:
    """In how many bits two parities differ, in the length of the shorter one."""
    words = F.least(F.size(a), F.size(b))

    def folded(parity: Column, at: Column) -> Column:
        places = F.sequence(at, F.size(parity) - 1, words)
        return F.aggregate(places, F.lit(0).cast("long"), lambda bits, k: bits.bitwiseXOR(F.get(parity, k)))

    return F.aggregate(
        F.sequence(F.lit(0), words - 1), F.lit(0),
        lambda apart, at: apart + F.bit_count(folded(a, at).bitwiseXOR(folded(b, at))),
    )


def _prefixes(docs: DataFrame, text: str, key: str, width: int, similarity: float, common: tuple) -> DataFrame:
    """``key``, id and size n of the shingle set, fp, the text's fingerprint as of :func:`fingerprints`, the set's
    parity, and keys: its rarest shingles, which two alike sets cannot both avoid."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, id long, n int, fp long, parity array<long>, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [value.as_py() or "" for value in batch.column(1)]
            sets = [shingle_set(value, width) for value in texts]
            prints = np.array([fingerprint_bytes(value, PRINT_WIDTH) for value in texts], np.uint64).view(np.int64)
            keys = [_rare_first(own, *common)[: len(own) - ceil(similarity * len(own) - 1e-9) + 1] for own in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([_set_id(own) for own in sets], pa.int64()),
                pa.array([len(own) for own in sets], pa.int32()),
                pa.array(prints), _lists([set_parity(own) for own in sets]), _lists(keys),
            ], names=[key, "id", "n", "fp", "parity", "keys"])

    return docs.select(key, text).mapInArrow(run, schema)


def near_copies(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = COPY_WIDTH, similarity: float = COPY_SIMILARITY,
    sample_rows: int = 10_000, most_common: int = 200_000, radius: int = 3,
) -> DataFrame:
    """Per row of ``docs``: ``key`` and component_id, the smallest ``key`` reachable over texts whose sets of
    ``width``-word shingles have at least this Jaccard likeness. A written table.

    Equal sets are one class, and texts without a word are alike. Repeated rows come back repeated. Classes whose
    fingerprints are within ``radius`` bits are compared first; pairs farther apart come from the rarest shingles.
    ``sample_rows`` and ``most_common`` bound what the order of the shingles is learned from, not what is found.
    """
    common = _common_shingles(docs, text, key, width, sample_rows, most_common)
    signed = stored(_prefixes(docs, text, key, width, similarity, common), "copy-prefixes")
    rows = stored(signed.select(key, "id"), "copy-rows")
    # all rows of one id have the same n and parity
    classes = stored(signed.groupBy("id").agg(
        F.min(key).alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("parity").alias("parity"),
    ), "copy-classes")
    members = signed.select("id", "n", F.posexplode("keys").alias("place", "key"))
    crowded = members.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    crowded = stored(crowded, "copy-keys")
    buckets = members.join(small_side(crowded), "key").select("key", "id", "n", (F.col("n") - F.col("place")).alias("rest"))
    buckets = stored(buckets.distinct(), "copy-buckets")
    free(signed, crowded)
    collect_garbage(docs.sparkSession)
    close = _alike(_close_sets(classes, radius), docs, classes, text, key, width, similarity)
    first = _alike(bucket_candidates(buckets, None, similarity), docs, classes, text, key, width, similarity)
    before = first.unionByName(close)
    found = components(before, "copy-components")
    known = component_sizes(found)
    more = _alike(bucket_candidates(buckets, known, similarity), docs, classes, text, key, width, similarity)
    free(buckets, found, known)
    found = components(before.unionByName(more), "copy-components")
    rooted = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(
        "id", "least", F.coalesce("component", "id").alias("component"))
    roots = rooted.groupBy("component").agg(F.min("least").alias("component_id"))
    named = rooted.join(roots, "component").select("id", "component_id")
    near = stored(rows.join(named, "id").select(key, "component_id"), "copy-near")
    free(rows, classes, close, first, more, found)
    return near


def _close_sets(classes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of ids of ``classes`` (id, fp) whose fingerprints are linked, by the least id of each fingerprint."""
    named = classes.groupBy("fp").agg(F.min("id").alias("least_id"))
    equal = classes.join(named, "fp").where("id != least_id").select(F.col("id").alias("a"), F.col("least_id").alias("b"))
    linked = links(named, radius).join(named.select(F.col("fp").alias("u"), F.col("least_id").alias("a")), "u").join(
        named.select(F.col("fp").alias("v"), F.col("least_id").alias("b")), "v")
    return equal.unionByName(linked.select("a", "b"))


def _alike(
    pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str, key: str, width: int, similarity: float,
) -> DataFrame:
    """Edges (u, v) of the pairs (a, b) of set ids whose whole sets, made again from one row of each, are alike.

    The parities in ``classes`` drop pairs that differ in too many members first, and no others: there are many times more
    pairs that share a rare shingle than alike ones, and a set takes 64 times the room of its parity. A written table.
    """
    one, two = (classes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab")
    total = F.col("na") + F.col("nb")
    near = pairs.join(one, "a").join(two, "b").where(
        _bits_apart(F.col("pa"), F.col("pb")) * (1 + similarity) <= total * (1 - similarity) + 1e-6)
    pairs = stored(near.select("a", "b"), "copy-pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    chosen = stored(classes.join(ids, "id").select("id", "least"), "copy-wanted")
    wanted = small_side(chosen)
    texts = docs.join(wanted, F.col(key).eqNullSafe(F.col("least")), "left_semi")
    # a key may have other rows, with other sets
    sets = _shingle_sets(texts, text, width).join(wanted.select("id"), "id", "left_semi")
    sets = stored(sets.groupBy("id").agg(F.first("members").alias("members")), "copy-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("sa")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("members").alias("sb")), "b")
    counted = both.select(
        "a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("total"),
    )
    edges = stored(counted.where(F.col("n") >= F.lit(similarity) * (F.col("total") - F.col("n")) - 1e-9).select(
        F.col("a").alias("u"), F.col("b").alias("v")), "copy-edges")
    free(pairs, chosen, sets)
    collect_garbage(docs.sparkSession)
    return edges


def deduplicate(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = COPY_WIDTH, similarity: float = COPY_SIMILARITY,
) -> DataFrame:
    """``docs`` with the smallest ``key`` of each component of near copies kept; columns and order of columns as given."""
    near = near_copies(docs, text, key, width, similarity)
    gone = stored(near.where(F.col(key) != F.col("component_id")).select(key).distinct(), "copy-gone")
    free(near)
    return docs.join(small_side(gone), key, "left_anti").select(*docs.columns)
