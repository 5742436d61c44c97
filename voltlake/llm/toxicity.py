"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is logistic in the weights of its words and of their beginnings (which inflected
and compounded forms share); a document's is the noisy-or of its sentences,
1 - prod(1 - p). Only documents have labels, and the gradient of their likelihood trains the sentences.
The same weights then name the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import word_hashes
from .common import clean_text, stored
from .labelled import fold, labelled_sample

PER_CLASS = 3000
SLOT_BITS = 18
MAX_FEATURES = 20_000
THRESHOLD = 0.3
BLOCK_BYTES = 400_000
BEGINNINGS = (4, 5, 6, 7, 8)  # bytes
WIDE = 1 + len(BEGINNINGS)  # features of a word
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True


@dataclass
class Model:
    """Weights of hashed words and the bias of a sentence."""

    weights: np.ndarray
    bias: float

    def sentence_logits(self, slots: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        if not len(firsts):
            return np.zeros(0)
        return self.bias + np.add.reduceat(self.weights[slots], firsts)


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature slots in order, every sentence's first slot, its text's number, and its place in the joined texts.

    Each word has WIDE slots; slot 0 stands for none. A sentence ends at a full stop, exclamation or question mark or line end; one without a word is none.
    """
    words, counts, starts = word_hashes(texts, BEGINNINGS)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.flatnonzero(_ENDS[data])
    row = np.repeat(np.arange(len(texts)), counts)
    sentence = np.searchsorted(ends, starts)
    new = np.ones(len(words), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (row[1:] != row[:-1])
    firsts = np.flatnonzero(new)
    slots = (words >> np.uint64(64 - SLOT_BITS)).astype(np.int64).ravel()
    return slots, firsts * WIDE, row[firsts], starts[firsts]


def fit(
    word: np.ndarray, owner: np.ndarray, row: np.ndarray, labels: np.ndarray, weight: np.ndarray, n_words: int,
    rounds: int = 150,
) -> tuple[np.ndarray, float]:
    """Weights and bias of greatest penalised likelihood of the noisy-or, by Adam over the whole sample.

    ``word`` numbers the features, ``owner`` is each one's sentence, ``row`` each sentence's document and
    ``weight`` each document's weight. Without both labels all weights are 0.
    """
    values, bias = np.zeros(n_words), -6.0
    n_docs, n_sentences = len(labels), len(row)
    if not len(word) or labels.min() == labels.max():
        return values, bias
    moment, square = np.zeros(n_words + 1), np.zeros(n_words + 1)
    total = weight.sum()
    for step in range(1, rounds + 1):
        logit = bias + np.bincount(owner, values[word], n_sentences)
        chance = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        safe = np.bincount(row, np.logaddexp(0, logit), n_docs)
        pull = np.where(labels > 0, np.exp(-safe) / np.maximum(-np.expm1(-safe), 1e-9), -1.0) * weight / total
        slope = chance * pull[row]
        gradient = np.append(np.bincount(word, slope[owner], n_words) - 1e-5 * values, slope.sum())
        moment = 0.9 * moment + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        change = 0.15 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        values, bias = values + change[:-1], bias + change[-1]
    return values, float(bias)


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


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", use: Column | None = None, per_class: int = PER_CLASS,
    key: str = "doc_id", text: str = "text",
) -> Model:
    """A model from at most ``per_class`` labelled documents of each kind, weighted to the kinds' true shares.

    Executors write word slots, no texts; the MAX_FEATURES most telling ones reach the driver. By default the rows whose crc32 modulo 4 is not 2 are used.
    Without both kinds of label every sentence has the chance of the bias.
    """
    use = fold(key, 4) != 2 if use is None else use
    rows, counts = labelled_sample(docs, labels, label, use, per_class, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(0)):
                slots, firsts, row, _ = sentences(block)
                cuts = np.searchsorted(row, np.arange(len(block) + 1))
                edges = np.append(firsts, len(slots))
                own = [slots[edges[a]:edges[b]].astype(np.int32) for a, b in zip(cuts, cuts[1:])]
                sizes = [np.diff(edges[a:b + 1]).astype(np.int32) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(1).slice(at, len(block)), pa.array(own, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())),
                ], names=["label", "slots", "sizes"])
                at += len(block)

    sample = stored(
        rows.select(F.lower("text"), "label").mapInArrow(run, "label int, slots array<int>, sizes array<int>"), "toxic-sample",
    )
    taken = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(np.zeros(1 << SLOT_BITS, np.float32), -6.0)
    if len(taken) < 2:
        return model
    known = _telling(sample, taken[1], taken[0])

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = [], []
            for own, lengths in zip(batch.column(1), batch.column(2)):
                slots = own.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, slots), max(0, len(known) - 1))
                keep = known[at] == slots if len(known) else np.zeros(len(slots), bool)
                sentence = np.repeat(np.arange(len(lengths.values)), lengths.values.to_numpy(zero_copy_only=False))
                words.append(at[keep].astype(np.int32))
                sizes.append(np.bincount(sentence[keep], minlength=len(lengths.values)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(words, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32())),
            ], names=["label", "words", "sizes"])

    table = sample.mapInArrow(compact, "label int, words array<int>, sizes array<int>").toArrow()
    marks = table["label"].to_numpy()
    weight = np.array([counts.get(k, 0) / max(1, taken.get(k, 0)) for k in (0, 1)])[marks]
    per_doc = pa.compute.list_value_length(table["sizes"]).to_numpy()
    words = pa.compute.list_flatten(table["words"]).to_numpy()
    sizes = pa.compute.list_flatten(table["sizes"]).to_numpy()
    del table
    row = np.repeat(np.arange(len(marks)), per_doc)
    values, model.bias = fit(words, np.repeat(np.arange(len(sizes)), sizes), row, marks, weight, len(known))
    model.weights[known] = values
    return model


def _telling(sample: DataFrame, n_toxic: int, n_civil: int) -> np.ndarray:
    """The MAX_FEATURES slots whose shares in the two kinds of document differ most for their frequency, in order."""
    each = sample.select("label", F.explode(F.array_distinct("slots")).alias("slot")).where("slot > 0")
    seen = each.groupBy("slot").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where("a + b >= 3")
    share = (F.col("a") + F.col("b")) / (n_toxic + n_civil)
    gap = F.col("a") / n_toxic - F.col("b") / n_civil
    telling = seen.select("slot", (gap * gap / (share * (1.0001 - share))).alias("weight"))
    chosen = telling.orderBy(F.desc("weight"), "slot").limit(MAX_FEATURES).toPandas()["slot"].to_numpy(np.int64)
    return np.sort(chosen)


def score(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """Per row: ``key``, score, predicted (1 if score >= ``threshold``) and offending.

    offending lists (start, end, chance) in code points of the sentences whose own chance reaches the
    threshold; start is the first word's, end the next sentence's start or the text's end. A text without
    words (null, empty) scores 0. The model is 2 ** SLOT_BITS floats, whatever the corpus.
    """
    kind = docs.schema[key].dataType.simpleString()
    cut = float(np.log(threshold / (1 - threshold))) if 0 < threshold < 1 else np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                slots, firsts, row, places = sentences(block)
                logits = model.sentence_logits(slots, firsts)
                safe = np.bincount(row, np.logaddexp(0, logits), len(block))
                found: list[list[dict]] = [[] for _ in block]
                bounds = np.cumsum([0, *(len(raw) + 1 for raw in block)])
                for k in np.flatnonzero(logits >= cut).tolist():
                    own, raw = int(row[k]), block[row[k]]
                    start = int(places[k] - bounds[own])
                    end = int(places[k + 1] - bounds[own]) if k + 1 < len(row) and row[k + 1] == own else len(raw)
                    first = len(raw[:start].decode("utf-8", "replace"))
                    found[own].append({
                        "start": first, "end": first + len(raw[start:end].decode("utf-8", "replace")),
                        "chance": float(1 / (1 + np.exp(-logits[k]))),
                    })
                total = -np.expm1(-safe)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(block)), pa.array(total), pa.array((total >= threshold).astype(np.int32)),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))),
                ], names=[key, "score", "predicted", "offending"])
                at += len(block)

    schema = f"{key} {kind}, score double, predicted int, offending array<struct<start:int,end:int,chance:double>>"
    return docs.select(key, F.lower(clean_text(text)).alias("text")).mapInArrow(run, schema)


def keep_civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns as given, nothing shuffled."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index(text)
        for batch in batches:
            at = 0
            for block in _blocks(pa.compute.utf8_lower(batch.column(place).fill_null(""))):
                slots, firsts, row, _ = sentences(block)
                safe = np.bincount(row, np.logaddexp(0, model.sentence_logits(slots, firsts)), len(block))
                yield batch.slice(at, len(block)).filter(pa.array(-np.expm1(-safe) < threshold))
                at += len(block)

    return docs.mapInArrow(run, schema)
