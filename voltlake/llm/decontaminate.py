"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become word sequences. Runs of ``min_match`` words are hashed by Karp-Rabin;
an equi-join on the hash pairs the places where a document and an item share such a seed. Seeds in a row on
one diagonal are one longer match, so the hashes of longer runs need not be made. In each (document, item)
pair the longest match of unmarked words is marked again and again, until none of ``min_match`` words is
left; a match that lost words to a longer one goes on with what is left of it. Tiles do not overlap and may come in any order, so a passage with its sentences shuffled is covered like the original.
An item's coverage is the share of its words under tiles.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import gram_hashes, word_hashes
from .common import clean_text

MIN_MATCH = 6
THRESHOLD = 0.5
FILTER_BITS = 24
BLOCK_BYTES = 400_000


def _grams(frame: DataFrame, key: str, text: str, size: int, wanted: np.ndarray | None) -> DataFrame:
    """key, place, gram (and n_words) of every run of ``size`` words whose hash passes the filter.

    The filter is a fixed table of 2 ** FILTER_BITS bits of the other side's hashes; what passes by
    chance falls out of the join.
    """
    kind = frame.schema[key].dataType.simpleString()
    table = None if wanted is None else wanted.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.frombuffer(table, np.uint64)
        for batch in batches:
            at = 0
            for texts in _blocks(batch.column(1)):
                words, counts, _ = word_hashes(texts)
                row = np.repeat(np.arange(len(texts)), counts)
                place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
                grams = gram_hashes(words, size)
                keep = row[: len(grams)] == row[size - 1:size - 1 + len(grams)]
                if bits is not None:
                    slot = grams >> np.uint64(64 - FILTER_BITS)
                    keep &= (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                kept = np.flatnonzero(keep)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(at, len(texts)).take(pa.array(row[kept])),
                        pa.array(place[kept].astype(np.int32)),
                        pa.array(counts[row[kept]].astype(np.int32)),
                        pa.array(grams[kept].view(np.int64)),
                    ], names=[key, "place", "n_words", "gram"])
                at += len(texts)

    schema = f"{key} {kind}, place int, n_words int, gram long"
    return frame.select(key, F.lower(clean_text(text)).alias("text")).mapInArrow(run, schema)


def _blocks(texts: pa.Array) -> Iterator[list[bytes]]:
    block, size = [], 0
    for value in texts:
        raw = value.as_py().encode("utf-8", "surrogatepass")
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(raw)
        size += len(raw)
    if block:
        yield block


def _filter(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed's leading hash bits, gathered as at most 2 ** (FILTER_BITS - 6) numbers."""
    slot = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(gram, {64 - FILTER_BITS}) & 63 as int))")
    rows = seeds.groupBy(F.shiftrightunsigned(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def tiles(matches: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of the seeds (place in the document, place in the item) of one pair.

    Seeds in a row on one diagonal make a match of their number plus ``size`` - 1 words. The longest
    match whose words are all unmarked is marked first (ties: earliest in the document, then the item);
    what is left of a match that lost words is tried again if it has ``size`` words or more. Returns
    (place in the document, place in the item, words).
    """
    runs: dict[int, list[list[int]]] = defaultdict(list)
    for d, i in sorted(set(matches)):
        line = runs[d - i]
        if line and line[-1][0] + line[-1][2] == d:
            line[-1][2] += 1
        else:
            line.append([d, i, 1])
    return tiles_of_runs([tuple(run) for line in runs.values() for run in line], size)


def tiles_of_runs(runs: Iterable[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """:func:`tiles` of runs of seeds: (place in the document, place in the item, seeds in a row)."""
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, i, seeds in runs:
        by_length[seeds + size - 1].append((d, i))
    marked_d: set[int] = set()
    marked_i: set[int] = set()
    found = []
    while by_length:
        length = max(by_length)
        for d, i in sorted(by_length.pop(length)):
            free = [k for k in range(length) if d + k not in marked_d and i + k not in marked_i]
            if len(free) == length:
                found.append((d, i, length))
                marked_d.update(range(d, d + length))
                marked_i.update(range(i, i + length))
                continue
            start = None
            for k in [*free, None]:
                if start is not None and (k is None or k != last + 1):
                    if last - start + 1 >= size:
                        by_length[last - start + 1].append((d + start, i + start))
                    start = None
                if start is None:
                    start = k
                last = k
    return found


def contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
    item_text: str = "text", min_match: int = MIN_MATCH, threshold: float = THRESHOLD,
) -> DataFrame:
    """Pairs (``key``, ``item``) with coverage >= ``threshold``: item_words, covered, n_tiles, coverage.

    Words are compared in lower case without punctuation. An item of fewer than ``min_match`` words, or
    with a null text, has no seed and is never covered. Repeated rows of a document or an item count as
    one place list each (keys are expected to be unique). Documents are read once; only seed places that
    pass a bit filter of the benchmark are shuffled. One group holds the runs of seeds that one document shares with
    one item, however many documents share a passage; seeds in a row are one run before they meet in it, so
    repeated words make as many runs as there are diagonals, not as there are pairs of places.
    """
    seeds = _grams(benchmark, item, item_text, min_match, None).select(
        F.col(item).alias("item_id"), F.col("place").alias("item_place"), F.col("n_words").alias("item_words"), "gram",
    ).distinct()
    hits = _grams(docs, key, text, min_match, _filter(seeds)).select(F.col(key).alias("doc_key"), "place", "gram")
    pair = ["doc_key", "item_id", "item_words"]
    diagonal = F.col("place") - F.col("item_place")
    matches = hits.join(seeds, "gram").select(*pair, "place", "item_place").distinct()
    nth = F.row_number().over(Window.partitionBy(*pair, diagonal).orderBy("place"))
    runs = matches.withColumn("run", F.col("place") - nth).groupBy(*pair, diagonal.alias("diagonal"), "run").agg(
        F.min("place").alias("place"), F.min("item_place").alias("item_place"), F.count(F.lit(1)).cast("int").alias("seeds"),
    )
    pairs = runs.groupBy(*pair).agg(F.collect_list(F.struct("place", "item_place", "seeds")).alias("runs"))
    kinds = {c: pairs.schema[c].dataType.simpleString() for c in ("doc_key", "item_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                tiles_of_runs([(r["place"], r["item_place"], r["seeds"]) for r in own], min_match)
                for own in batch.column("runs").to_pylist()
            ]
            covered = np.array([sum(t[2] for t in own) for own in found], np.int32)
            words = batch.column("item_words").to_numpy()
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_key"), batch.column("item_id"), batch.column("item_words"), pa.array(covered),
                pa.array([len(own) for own in found], pa.int32()), pa.array(covered / words),
            ], names=["doc_key", "item_id", "item_words", "covered", "n_tiles", "coverage"])

    schema = (
        f"doc_key {kinds['doc_key']}, item_id {kinds['item_id']}, item_words int, covered int, n_tiles int, "
        "coverage double"
    )
    scored = pairs.mapInArrow(run, schema).where(F.col("coverage") >= threshold)
    return scored.withColumnRenamed("doc_key", key).withColumnRenamed("item_id", item)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", **limits) -> DataFrame:
    """``docs`` without the rows that cover an item; columns as given.

    A row is known by its key and its text (two 64-bit hashes of it), so a null or repeated key neither saves a
    row that covers an item nor takes a clean one along.
    """
    row = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("row"), text).alias("h2"))
    bad = contamination(docs.select(row.alias("row"), F.col(text).alias("row_text")), benchmark, "row_text", "row", **limits)
    bad = bad.select(F.col("row").alias("bad_row")).distinct()
    return docs.select(F.struct("*").alias("doc"), row.alias("row")).join(bad, F.col("row") == F.col("bad_row"), "left_anti").select("doc.*")
