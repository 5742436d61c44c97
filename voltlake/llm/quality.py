"""Quality by compression: text is good if it compresses better with a dictionary of good text than with one of bad.

Two zstandard dictionaries are built from blocks of labelled texts. Every text is cut into blocks, each of
which is compressed with either dictionary alone, so that a long text does not drown the dictionaries in
what it teaches the compressor itself. A logistic regression on labelled texts that the dictionaries have not seen
makes a probability of it. Its terms are the difference of the two sizes as a share of their sum, that times the log
length, and, without the difference, the ratio of the better size to the bare length, the log length and both squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clean_text
from .labelled import fold, labelled_sample

PER_CLASS = 3000
BLOCK_BYTES = 1024
BLOCKS_PER_CLASS = 3000
DICTIONARY_BYTES = 96_000
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the calibration: score = logistic of a linear function of :func:`features`."""

    good: bytes
    bad: bytes
    coefficients: tuple[float, ...]


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    made = []
    for data in (good, bad):
        dictionary = zstandard.ZstdCompressionDict(data)
        dictionary.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(
            dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False,
        ))
    return made[0], made[1]


def sizes(raw: bytes, good: bytes, bad: bytes) -> tuple[int, int]:
    """Bytes of the whole text compressed in blocks with the good and with the bad dictionary."""
    with_good, with_bad = _compressors(good, bad)
    blocks = [raw[at:at + BLOCK_BYTES] for at in range(0, len(raw), BLOCK_BYTES)]
    return sum(len(with_good.compress(b)) for b in blocks), sum(len(with_bad.compress(b)) for b in blocks)


def features(raw: bytes, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """Normalised difference of the sizes, that of the better size to the bare length, and the log length."""
    n_good, n_bad = sizes(raw, good, bad)
    if not raw:
        return 0.0, 0.0, 0.0
    return (n_bad - n_good) / (n_bad + n_good), min(n_good, n_bad) / len(raw), float(np.log1p(len(raw)))


def _design(values: np.ndarray) -> np.ndarray:
    """Constant, difference, ratio, length, and the squares of the last two (both ends can be odd)."""
    d, ratio, length = values[:, 0] * 10, values[:, 1], values[:, 2] / 5
    return np.stack([np.ones(len(d)), d, d * length, ratio, ratio**2, length, length**2], axis=1)


def _calibrate(values: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    x = _design(values)
    beta = np.zeros(x.shape[1])
    share = (weight @ labels + 1) / (weight.sum() + 2)
    beta[0] = np.log(share / (1 - share))
    ridge = np.full(len(beta), 1.0)
    ridge[0] = 1e-3
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (labels - chance)) - ridge * beta
        hessian = (x * (weight * chance * (1 - chance))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(beta.tolist())


def _dictionary(blocks: list[bytes]) -> bytes:
    """A trained dictionary, or the blocks themselves where they are too few to train on."""
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 4))
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:] or b"        "


def _blocks(rows: DataFrame, wanted: int) -> list[bytes]:
    """At most ``wanted`` blocks of the rows' texts, the first by hash of key and place."""
    raw = F.encode("text", "utf-8")
    cut = rows.select("doc_id", raw.alias("raw")).select(
        "doc_id", "raw", F.explode(F.sequence(F.lit(0), (F.octet_length("raw") - 1).cast("int"), F.lit(BLOCK_BYTES))).alias("at"),
    ).select("doc_id", "at", F.expr(f"substring(raw, at + 1, {BLOCK_BYTES})").alias("block"))
    chosen = cut.orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(wanted).collect()
    return [bytes(r["block"]) for r in chosen]


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", use: Column | None = None,
    per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text",
) -> Model:
    """Dictionaries and calibration from at most ``per_class`` labelled texts of each kind.

    By default the rows whose crc32 modulo 5 is not 0. Of these, two in three (by another hash) give
    blocks to the dictionaries, at most BLOCKS_PER_CLASS a kind, the others calibrate, weighted to the
    kinds' true shares. Where one kind is missing, both dictionaries are alike and the score is the share.
    """
    use = fold(key, 5) != 0 if use is None else use
    rows, counts = labelled_sample(docs, labels, label, use, per_class, key, text)
    rows = rows.select(F.col(key).alias("doc_id"), "text", "label")
    build = F.pmod(F.xxhash64("doc_id", F.lit("build")), F.lit(3)) > 0
    filled = rows.where(build & (F.length("text") > 0))
    blocks = [_blocks(filled.where(F.col("label") == k), BLOCKS_PER_CLASS) for k in (1, 0)]
    good, bad = (_dictionary(b) for b in blocks)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([features(v.as_py().encode("utf-8", "surrogatepass"), good, bad) for v in batch.column(0)]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, k]) for k in range(3)] + [batch.column(1)], names=["d", "ratio", "length", "label"])

    table = rows.where(~build).select("text", "label").mapInArrow(measure, "d double, ratio double, length double, label int").toArrow()
    marks = table["label"].to_numpy()
    values = np.stack([table[c].to_numpy() for c in ("d", "ratio", "length")], axis=1)
    if not all(blocks):
        values = np.zeros_like(values)
    taken = np.bincount(marks, minlength=2)
    weight = np.array([counts.get(k, 0) / max(1, taken[k]) for k in (0, 1)])
    weight = weight / max(1e-9, (weight * taken).sum()) * max(1, taken.sum())
    return Model(good, bad, _calibrate(values, marks.astype(float), weight[marks] if len(marks) else np.zeros(0)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, score (chance of label 1), predicted, good_bytes, bad_bytes.

    Null and empty texts have no bytes and the score of a difference of 0. The model holds two dictionaries
    of at most DICTIONARY_BYTES, whatever the corpus; nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = np.array(model.coefficients)
        for batch in batches:
            pairs, lengths = [], []
            for value in batch.column(1):
                raw = value.as_py().encode("utf-8", "surrogatepass")
                pairs.append(sizes(raw, model.good, model.bad))
                lengths.append(len(raw))
            n = np.array(pairs, np.float64).reshape(-1, 2)
            length = np.array(lengths, np.float64)
            d = (n[:, 1] - n[:, 0]) / np.maximum(n.sum(axis=1), 1)
            values = np.stack([d, n.min(axis=1) / np.maximum(length, 1), np.log1p(length)], axis=1)
            chance = 1 / (1 + np.exp(-np.clip(_design(values) @ beta, -30, 30)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(chance), pa.array((chance >= threshold).astype(np.int32)),
                pa.array(n[:, 0].astype(np.int64)), pa.array(n[:, 1].astype(np.int64)),
            ], names=[key, "score", "predicted", "good_bytes", "bad_bytes"])

    schema = f"{key} {kind}, score double, predicted int, good_bytes long, bad_bytes long"
    return docs.select(key, clean_text(text).alias("text")).mapInArrow(run, schema)
