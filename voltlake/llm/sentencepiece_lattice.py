"""SentencePiece encoding and decoding with the N best segmentations.

The piece lattice of a text has an edge for every vocabulary piece that matches. A forward Viterbi pass
gives the best score from the start to every position. As the heuristic of a backward A* search from the
end it is exact, so complete paths leave the queue in the order of their scores. No piece of the model
holds a space mark after another character, so the lattice is a chain of independent units (space marks
and the word after them). Within a block of texts each distinct unit is solved once, many at a time:
forward and backward Viterbi scores give its best path and the exact distance of its second best. Only
the units with the least distances can differ in the N best segmentations of a text, and only those are
searched with A*.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from math import inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
STAND_IN = "\udfff"  # for a space mark that the text itself holds; UTF-8 text cannot hold this
BLOCK_CHARS = 3_000_000
LONG_UNIT = 48
BASE = np.uint64(0x9E3779B97F4A7C15)
BUCKETS = 18


Edit = tuple[int, int, tuple[int, ...]]
EDITS = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))


class PieceModel:
    """Pieces and scores of a trained model file (read, never trained).

    A model of kind BPE stores merge ranks, no probabilities; they become log-probabilities of a Zipf law
    on the rank. A character without a piece of its own is written as its UTF-8 bytes, as is a space mark
    that the text itself holds, so that decoding always gives the text back.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ids = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        raw = {i: model.get_score(i) for i in ids if not model.is_byte(i)}
        if min(raw.values()) < -1000:
            norm = log(sum(1 / (2 - s) for s in raw.values()))
            raw = {i: -log(2 - s) - norm for i, s in raw.items()}
        self.pieces = {model.id_to_piece(i): (s, i) for i, s in raw.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("a piece of this model spans units")
        self.longest = max(map(len, self.pieces))
        self.byte_score = min(raw.values()) - 10
        marks = {i: p.replace(SPACE, " ") for p, (_, i) in self.pieces.items()}
        self.texts = [marks.get(i, "") for i in range(size)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        for b in range(128):  # such a byte is a character by itself
            self.texts[self.byte_ids[b]] = chr(b)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids[128:]] = True
        lone = "".join(c for c in "\n" if not any(c in p and len(p) > 1 for p in self.pieces))
        self.units = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]" if lone else ""))
        self.tables = [self._table([p for p in self.pieces if len(p) == n]) for n in range(1, self.longest + 1)]

    def _table(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in order, their scores and ids, and a coarse table of hash buckets in use."""
        used = np.zeros(1 << BUCKETS, bool)
        if not pieces:
            return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int32), used
        codes = _code_points(pieces, len(pieces[0]))
        hashes = np.zeros(len(pieces), np.uint64)
        for k in range(codes.shape[1]):
            hashes = (hashes + codes[:, k]) * BASE
        order = np.argsort(hashes)
        hashes = hashes[order]
        used[hashes >> np.uint64(64 - BUCKETS)] = True
        values = [self.pieces[pieces[k]] for k in order]
        return hashes, np.array([s for s, _ in values]), np.array([i for _, i in values], np.int32), used

    def split(self, text: str) -> list[str]:
        """The text as units. A space mark goes before it, as models of this kind do."""
        return self.units.findall(SPACE + text.replace(SPACE, STAND_IN).replace(" ", SPACE)) if text else []

    def edges(self, unit: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For every end position the edges (start, score, ids) of the lattice that end there."""
        ends = []
        for end in range(1, len(unit) + 1):
            found = []
            for start in range(max(0, end - self.longest), end):
                piece = self.pieces.get(unit[start:end])
                if piece:
                    found.append((start, piece[0], (piece[1],)))
            if unit[end - 1] not in self.pieces:
                char = SPACE if unit[end - 1] == STAND_IN else unit[end - 1]
                raw = char.encode("utf-8", "surrogatepass")
                found.append((end - 1, self.byte_score * len(raw), tuple(self.byte_ids[b] for b in raw)))
            ends.append(found)
        return ends

    def nbest_unit(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one unit (score, ids) by backward A*, best first.

        Each of the n best has one of the n best ways from the end to every position on it, so a position that
        has been taken off the queue n times is done; where many segmentations tie, the search would else
        take up every one of them.
        """
        ends = self.edges(unit)
        forward = [0.0] + [-inf] * len(unit)
        for end, found in enumerate(ends, 1):
            forward[end] = max(forward[start] + score for start, score, _ in found)
        queue: list[tuple] = [(-forward[-1], 0, len(unit), 0.0, ())]
        best, order, taken = [], 1, [0] * (len(unit) + 1)
        while queue and len(best) < n:
            _, _, end, behind, path = heapq.heappop(queue)
            taken[end] += 1
            if taken[end] > n:
                continue
            if end == 0:
                ids: list[int] = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                best.append((behind, tuple(ids)))
                continue
            for start, score, own in ends[end - 1]:
                total = behind + score
                heapq.heappush(queue, (-(forward[start] + total), order, start, total, (own, path)))
                order += 1
        return best

    def solve(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit: best score, distance of the second best, number of ids; and all ids in turn."""
        score, gap, counts = np.zeros(len(units)), np.full(len(units), inf), np.zeros(len(units), np.int64)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        paths: list[tuple[np.ndarray, np.ndarray]] = []
        alone = [np.flatnonzero(lengths > LONG_UNIT)]
        for n in np.unique(lengths[lengths <= LONG_UNIT]):
            rows = np.flatnonzero(lengths == n)
            for at in range(0, len(rows), 8192):
                part = rows[at:at + 8192]
                odd, own_score, own_gap, own_ids = self._solve_equal(_code_points([units[k] for k in part], int(n)))
                part_ok = part[~odd]
                score[part_ok], gap[part_ok] = own_score, own_gap
                counts[part_ok] = (own_ids >= 0).sum(axis=1)
                paths.append((part_ok, own_ids))
                alone.append(part[odd])
        single: dict[int, tuple[int, ...]] = {}
        for k in np.concatenate(alone).tolist():
            best = self.nbest_unit(units[k], 2)
            score[k], single[k], counts[k] = best[0][0], best[0][1], len(best[0][1])
            if len(best) > 1:
                gap[k] = best[0][0] - best[1][0]
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.int32)
        for rows, own_ids in paths:
            taken = own_ids >= 0
            place = starts[rows][:, None] + np.cumsum(taken, axis=1) - 1
            ids[place[taken]] = own_ids[taken]
        for k, own in single.items():
            ids[starts[k]:starts[k] + len(own)] = own
        return score, gap, counts, ids

    def _solve_equal(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward Viterbi for units of one length (a row of code points each).

        Returns which rows hold a character without a piece, and for the others the best score, the
        distance of the second best and the ids from left to right (-1: none there).
        """
        codes = np.ascontiguousarray(codes.T)
        n, longest = len(codes), min(len(codes), self.longest)
        hashes = np.zeros(codes.shape, np.uint64)
        scores, ids = [], []
        for size in range(1, longest + 1):
            hashes = (hashes[: n - size + 1] + codes[size - 1:]) * BASE
            known, values, own, used = self.tables[size - 1]
            s, i = np.full(hashes.shape, -inf), np.full(hashes.shape, -1, np.int32)
            place = np.flatnonzero(used[hashes >> np.uint64(64 - BUCKETS)])
            if len(known) and len(place):
                wanted = hashes.ravel()[place]
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                same = known[at] == wanted
                s.ravel()[place[same]], i.ravel()[place[same]] = values[at[same]], own[at[same]]
            if size == 1:
                odd = (i < 0).any(axis=0)
                if odd.any():
                    codes, hashes, s, i = codes[:, ~odd], hashes[:, ~odd], s[:, ~odd], i[:, ~odd]
            scores.append(s)
            ids.append(i)
        m = codes.shape[1]
        forward, backward = np.full((n + 1, m), -inf), np.full((n + 1, m), -inf)
        forward[0] = backward[n] = 0
        taken = np.zeros((n + 1, m), np.int8)
        for end in range(1, n + 1):
            for size in range(1, min(end, longest) + 1):
                total = forward[end - size] + scores[size - 1][end - size]
                better = total > forward[end]
                np.copyto(forward[end], total, where=better)
                np.copyto(taken[end], size, where=better)
        for start in range(n - 1, -1, -1):
            for size in range(1, min(n - start, longest) + 1):
                np.maximum(backward[start], backward[start + size] + scores[size - 1][start], out=backward[start])
        path = np.full((m, n), -1, np.int32)
        on_path = np.zeros((n + 1, m), np.int8)
        row, end = np.arange(m), np.full(m, n)
        while len(row):
            size = taken[end, row]
            on_path[end, row] = size
            for k in np.unique(size):
                own = size == k
                path[row[own], end[own] - k] = ids[k - 1][end[own] - k, row[own]]
            end = end - size
            row, end = row[end > 0], end[end > 0]
        second = np.full(m, -inf)
        for size in range(1, longest + 1):
            through = forward[: n - size + 1] + scores[size - 1] + backward[size:]
            through[on_path[size:] == size] = -inf
            np.maximum(second, through.max(axis=0), out=second)
        return odd, forward[n], np.maximum(forward[n] - second, 0), path

    def encode_all(self, texts: list[str], nbest: int = 1) -> Iterator[tuple[np.ndarray, list[float]]]:
        """Of each text the ids of the best segmentation and the scores of the ``nbest`` best."""
        for ids, scores, _ in self.encode_nbest(texts, nbest):
            yield ids, scores

    def encode_nbest(self, texts: list[str], nbest: int) -> Iterator[tuple[np.ndarray, list[float], list[list[Edit]]]]:
        """Of each text the ids of the best segmentation, the scores of the ``nbest`` best, and of each but
        the first the edits (place, number, ids instead; last place first) that make it of the best one's ids."""
        split = [self.split(text) for text in texts]
        units = list(dict.fromkeys(chain.from_iterable(split)))
        index = dict(zip(units, range(len(units))))
        codes = [np.fromiter(map(index.__getitem__, own), np.int64, len(own)) for own in split]
        del split, index
        score, gap, counts, ids = self.solve(units)
        starts = np.cumsum(counts) - counts

        @lru_cache(maxsize=None)
        def others(k: int) -> list[tuple[float, tuple[int, ...]]]:
            """Distances and ids of the unit's segmentations besides the one taken, which may not be the only best."""
            found = self.nbest_unit(units[k], nbest)
            taken = tuple(ids[starts[k]:starts[k] + counts[k]].tolist())
            return [(found[0][0] - s, own) for s, own in found if own != taken][: nbest - 1]

        for own in codes:
            lengths = counts[own]
            ends = np.cumsum(lengths)
            places = np.repeat(starts[own] - ends + lengths, lengths) + np.arange(lengths.sum())
            close = np.flatnonzero(gap[own] < inf)
            if len(close) > nbest - 1:
                close = close[np.argpartition(gap[own[close]], nbest - 1)[: nbest - 1]] if nbest > 1 else close[:0]
            close = np.sort(close)[::-1].tolist()
            total = float(score[own].sum())
            ways = [others(int(own[at])) for at in close]
            best = merged_gaps([tuple(g for g, _ in way) for way in ways], nbest)
            edits = [
                [
                    (int(ends[at] - lengths[at]), int(lengths[at]), way[pick - 1][1])
                    for at, way, pick in zip(close, ways, picks) if pick
                ]
                for _, picks in best[1:]
            ]
            yield ids[places], [total - behind for behind, _ in best], edits

    def decode(self, ids: np.ndarray | Iterable[int]) -> str:
        """The text of the ids; runs of byte ids are UTF-8."""
        ids = np.asarray(ids, np.int32)
        if not self.is_byte[ids].any():
            return "".join(map(self.texts.__getitem__, ids.tolist()))[1:]
        parts, raw = [], bytearray()
        for i in ids.tolist():
            if self.is_byte[i]:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(raw.decode("utf-8", "surrogatepass"))
                raw = bytearray()
            parts.append(self.texts[i])
        parts.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(parts)[1:]


def _code_points(units: list[str], n: int) -> np.ndarray:
    """Units of n characters as rows of code points plus one."""
    return np.array(units, f"U{n}").view(np.uint32).reshape(len(units), n).astype(np.uint64) + np.uint64(1)


def merged_gaps(gaps: list[tuple[float, ...]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums that take 0 or one of its ascending gaps from each unit, with what each takes (0, or which gap).

    With each unit's first gap among the n - 1 least no other unit can take part.
    """
    sums: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for own in gaps:
        sums = heapq.nsmallest(n, [(s + g, (*picks, k)) for s, picks in sums for k, g in enumerate((0.0, *own))])
    return sums[:n]


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    """Consecutive texts of about BLOCK_CHARS characters; a longer text is a block of its own."""
    block, chars = [], 0
    for value in texts:
        content = value.as_py() or ""
        if block and chars + len(content) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append(content)
        chars += len(content)
    if block:
        yield block


def encode_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = DEFAULT_MODEL, nbest: int = 3,
) -> DataFrame:
    """Per row: ``key``, piece_ids, n_pieces, nbest_scores (best first), nbest_edits and round_trip.

    nbest_edits has, for the second best segmentation and each one after it, what to replace in piece_ids:
    at (from 0), n and ids, last place first. ``nbest_ids`` makes all segmentations of it.

    Whole texts are encoded, and round_trip says that decoding the ids gave the text back. Null and empty
    texts have no pieces, one score of 0 and are true. ``model`` is a file that every executor has. Rows
    stream through Arrow block by block and nothing is shuffled; repeated rows come back repeated.
    """
    schema = (
        f"{key} {docs.schema[key].dataType.simpleString()}, piece_ids array<int>, n_pieces int, "
        "nbest_scores array<double>, nbest_edits array<array<struct<at:int,n:int,ids:array<int>>>>, round_trip boolean"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            at = 0
            for block in _blocks(batch.column(1)):
                ids, scores, edits, same = [], [], [], []
                for content, (own, best, other) in zip(block, pieces.encode_nbest(block, nbest)):
                    ids.append(own)
                    scores.append(best)
                    edits.append([[{"at": a, "n": n, "ids": i} for a, n, i in one] for one in other])
                    same.append(pieces.decode(own) == content)
                counts = np.fromiter(map(len, ids), np.int32, len(ids))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(block)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))),
                    pa.array(counts),
                    pa.array(scores, pa.list_(pa.float64())),
                    pa.array(edits, EDITS),
                    pa.array(same, pa.bool_()),
                ], names=[key, "piece_ids", "n_pieces", "nbest_scores", "nbest_edits", "round_trip"])
                at += len(block)

    return docs.select(key, text).mapInArrow(run, schema)


def nbest_ids(ids: str = "piece_ids", edits: str = "nbest_edits") -> Column:
    """The ids of all segmentations of an encoded row, best first."""
    def edited(own: Column, edit: Column) -> Column:
        return F.concat(
            F.slice(own, F.lit(1), edit["at"]), edit["ids"], F.slice(own, edit["at"] + edit["n"] + 1, F.size(own)),
        )

    return F.concat(F.array(F.col(ids)), F.transform(edits, lambda one: F.aggregate(one, F.col(ids), edited)))


def decode_documents(encoded: DataFrame, ids: str = "piece_ids", key: str = "doc_id", model: str = DEFAULT_MODEL) -> DataFrame:
    """Per row: ``key`` and the text of its ids; null ids give null."""
    schema = f"{key} {encoded.schema[key].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_model(model)
        for batch in batches:
            texts = [None if (own := value.as_py()) is None else pieces.decode(own) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, schema)
