"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

Merging by ranks has a local test: a row of tokens is the encoding of its bytes if and only if each token
and each two neighbours encode to themselves. So the encoding of a prefix is that of a shorter prefix and one
last token that fits behind the shorter prefix's last token, and exactly one choice fits. ``ByteBpe.solve``
goes through the ends of a piece once, with the tokens that end there from an Aho-Corasick automaton, and
notes the last token and the count of every prefix; nothing is ever encoded again.

A prefix is cut into pieces as the whole text is, but for its end, and three rules cover that: white space at the
end of a prefix is one piece (inside a text its last character stands alone or leads the next word), a
contraction that is cut in two is an apostrophe and a letter, and a special string that is cut is ordinary text.

``prefix_counts`` gives the counts as an array; ``budget`` and ``truncated`` answer from it, with DataFrame
expressions, how many tokens a text has, whether it fits, and the longest prefix that fits.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512

#: How byte-level pieces are cut, and its contractions of three characters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT_CONTRACTIONS = ("'re", "'ve", "'ll")

#: Characters on which two libraries may disagree whether they are letters, as that depends on the Unicode version;
#: texts with one are cut by the tokenizer library itself, which is slower.
DOUBTFUL = (
    "[԰-֏ࡠ-ࣿఀ-೿₀-₟꜀-꯿힤-\U00010000-\U0001efff\U00020000-\U0010ffff]"
)

CACHED_CHARS = 64
CACHED_PIECES = 200_000
CACHED_PAIRS = 1_000_000
BATCH_CHARS = 2_000_000


def _alphabet() -> dict[str, str]:
    """The visible character that stands for each byte in the vocabulary file, to that byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + k): chr(b) for k, b in enumerate(hidden)}


class _Solved(dict):
    """Counts of pieces met before; when full, the pieces met since the last time it was full stay."""

    def __init__(self, solve) -> None:
        super().__init__()
        self.solve, self.older = solve, {}

    def __missing__(self, piece: str) -> tuple[bytes, int, int, bool]:
        found = self.older.get(piece) or self.solve(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class ByteBpe:
    """A byte-level vocabulary file of the tokenizers library (read, never trained)."""

    def __init__(self, name: str) -> None:
        import ahocorasick
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if not plain or odd or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{name} is not a plain byte-level BPE vocabulary: {odd or before}")
        specials = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]) or any(
            a != b and a in b for a in specials for b in specials
        ):
            raise ValueError(f"special tokens of {name} that take in white space or hold each other are not supported")
        signs = str.maketrans(_alphabet())
        self.ids = {text.translate(signs): i for text, i in model["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a.translate(signs), b.translate(signs)): k for k, (a, b) in enumerate(pairs)}
        self.texts = {i: text for text, i in self.ids.items()}
        self.ends = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.ends.add_word(text, (i, len(text)))
        self.ends.make_automaton()
        self.specials = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.cut, self.doubtful = regex.compile(PIECES).findall, regex.compile(DOUBTFUL)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.made = {self.ids[a + b]: (self.ids[a], self.ids[b], k) for (a, b), k in self.ranks.items()}
        if any(self.made.get(part, (0, 0, -1))[2] >= k for a, b, k in self.made.values() for part in (a, b)):
            raise ValueError(f"{name} merges tokens before it makes them")
        self.pair_ranks = {(a, b): k for a, b, k in self.made.values()}
        self.edges: tuple[dict[int, list[tuple[int, int]]], ...] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self.solved = _Solved(self.solve)

    def _merged(self, text: str) -> list[str]:
        """Tokens of one or two tokens' bytes, by merging the pair of lowest rank, the first of them, again and again."""
        parts = list(text)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` (side 0: left, 1: right), smallest first, each with the rank of the merge that takes it in."""
        found = self.edges[side].get(token)
        if found is None:
            found, taken, part = [], len(self.ranks), token
            while True:
                found.append((part, taken))
                if part not in self.made:
                    break
                taken = self.made[part][2]
                part = self.made[part][side]
            found.reverse()
            self.edges[side][token] = found
        return found

    def _fit(self, before: int, token: int) -> bool:
        """Whether ``token`` encodes to itself behind ``before`` (-1: at the start).

        Merges inside either go by rank. Across the border two parts merge while both are there, if that
        comes before the merges that take them in; the left one is first where ranks are equal.
        """
        if before < 0:
            return self._merged(self.texts[token]) == [self.texts[token]]
        left, right, ranks = self._edge(before, 1), self._edge(token, 0), self.pair_ranks
        none, i, j = len(self.ranks), 0, 0
        while True:
            (a, taken_a), (b, taken_b) = left[i], right[j]
            across = ranks.get((a, b), none)
            if across < taken_a and across <= taken_b and across < none:
                return False
            if taken_a == taken_b == none:
                return True
            if taken_a <= taken_b:
                i += 1
            else:
                j += 1

    def solve(self, piece: str) -> tuple[bytes, int, int, bool]:
        """Tokens of every prefix of a piece (32-bit each), of the whole piece, its characters, and whether it is white space."""
        encoded, fits = piece.encode(), self.fits
        text = encoded.decode("latin-1")
        last, counts = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        for at, (token, length) in self.ends.iter(text):
            end, start = at + 1, at + 1 - length
            if last[end] < 0:
                pair = last[start], token
                fit = fits.get(pair)
                if fit is None:
                    if len(fits) >= CACHED_PAIRS:
                        fits.clear()
                    fit = fits[pair] = self._fit(*pair)
                if fit:
                    last[end], counts[end] = token, counts[start] + 1
        if len(encoded) > len(piece):  # only whole characters are prefixes
            found = [n for n, after in zip(counts[1:], [*encoded[1:], 0]) if not 0x80 <= after < 0xC0]
        else:
            found = counts[1:]
        if piece in CUT_CONTRACTIONS:
            found[1] = 2
        return array("I", found).tobytes(), counts[-1], len(piece), piece.isspace()

    def _segment(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... characters of a text without special strings."""
        if not text:
            return np.zeros(1, np.int64)
        if self.doubtful.search(text):
            pieces = [text[b:e] for _, (b, e) in self.library.pre_tokenize_str(text)]
        else:
            pieces = self.cut(text)
        found = [self.solved[p] for p in pieces]
        totals = np.fromiter((f[1] for f in found), np.int64, len(found))
        chars = np.fromiter((f[2] for f in found), np.int64, len(found))
        before = np.cumsum(totals) - totals
        counts = np.zeros(len(text) + 1, np.int64)
        counts[1:] = np.frombuffer(b"".join([f[0] for f in found]), np.uint32) + np.repeat(before, chars)
        ends = np.cumsum(chars)
        for k in [k for k, f in enumerate(found[:-1]) if f[3]]:
            # a prefix that ends behind the first character of the next piece ends in one longer run of white space
            first = pieces[k + 1][0]
            if first.isspace():
                counts[ends[k] + 1] = before[k] + self.solved[pieces[k] + first][1]
        return counts

    def counts(self, text: str) -> np.ndarray:
        """Tokens of the prefixes of 0, 1, ... characters of ``text``, as the library counts them by default."""
        parts, start, base = [np.zeros(1, np.int64)], 0, 0
        for special in self.specials.finditer(text) if self.specials else ():
            open_end = self._segment(text[start:special.end() - 1])
            parts.append(base + open_end[1:])
            base += int(open_end[special.start() - start]) + 1
            parts.append(np.array([base]))
            start = special.end()
        parts.append(base + self._segment(text[start:])[1:])
        return np.concatenate(parts)


@lru_cache(maxsize=2)
def _vocabulary(name: str) -> ByteBpe:
    return ByteBpe(name)


def _counted(batches: Iterator[pa.RecordBatch], name: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches with the counts of each row's text, its second column; no batch holds many more than BATCH_CHARS counts."""
    model = _vocabulary(name)
    for batch in batches:
        first, size, found = 0, 0, []
        texts = batch.column(1)
        for k in range(batch.num_rows):
            counts = model.counts(texts[k].as_py())[1:].astype(np.int32)
            found.append(counts)
            size += len(counts)
            if size >= BATCH_CHARS or k == batch.num_rows - 1:
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
                part = batch.slice(first, k + 1 - first)
                yield pa.RecordBatch.from_arrays([*part.columns, lists.cast(schema.field(2).type)], schema=schema)
                first, size, found = k + 1, 0, []


def prefix_counts(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = VOCABULARY) -> DataFrame:
    """Per row: ``key``, ``text`` (null: empty) and prefix_tokens, whose element i (from 0) counts the tokens of the first
    i + 1 characters (code points).

    Every row of ``docs`` comes back, repeated rows and null keys too; an empty text has an empty array. Other
    columns of ``docs`` are not read. A text is counted whole, in memory, at 4 bytes a character in the
    result; nothing is shuffled. Counts need not rise: a longer prefix may merge into fewer tokens.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, IntegerType, StructType

    rows = docs.select(F.col(key).alias(key), clean_text(text).alias(text))
    schema = StructType([*rows.schema.fields]).add("prefix_tokens", ArrayType(IntegerType(), False), False)
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(lambda batches: _counted(batches, name, arrow), schema)


def budget(prefixes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``prefixes`` with n_tokens, over_limit (more than ``limit``), and cut_chars, the characters of the longest prefix of ``limit`` tokens
    or less (all of them where the text fits)."""
    all_tokens = F.coalesce(F.try_element_at("prefix_tokens", F.lit(-1)), F.lit(0))
    fitting = F.transform("prefix_tokens", lambda n, k: F.when(n <= limit, k + 1).otherwise(0))
    return prefixes.select(
        "*", all_tokens.cast("long").alias("n_tokens"), (all_tokens > limit).alias("over_limit"),
        F.when(all_tokens <= limit, F.size("prefix_tokens")).otherwise(F.array_max(fitting)).cast("long").alias("cut_chars"),
    )


def tokens_of_first(prefixes: DataFrame, chars: int) -> DataFrame:
    """``prefixes`` with first_tokens, the tokens of each text's first ``chars`` characters (of all, if it has fewer)."""
    at = F.least(F.lit(chars), F.size("prefix_tokens"))
    return prefixes.withColumn("first_tokens", F.coalesce(F.get("prefix_tokens", at - 1), F.lit(0)))


def truncated(prefixes: DataFrame, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``prefixes`` with ``text`` cut to its longest prefix of ``limit`` tokens or less, and the prefix counts cut alike."""
    cut = budget(prefixes.select(F.struct("*").alias("row"), "prefix_tokens"), limit)
    kept = {
        text: F.substring(F.col("row")[text], F.lit(1), F.col("cut_chars").cast("int")),
        "prefix_tokens": F.slice("prefix_tokens", F.lit(1), F.col("cut_chars").cast("int")),
    }
    return cut.select(*[kept.get(c, F.col("row")[c]).alias(c) for c in prefixes.columns])


def report(docs: DataFrame, limit: int = LIMIT, text: str = "text", key: str = "doc_id", name: str = VOCABULARY) -> DataFrame:
    """Per row: ``key``, n_bytes, n_tokens, over_limit and cut_chars of ``budget``."""
    found = budget(prefix_counts(docs, text, key, name), limit)
    return found.select(key, F.octet_length(text).cast("long").alias("n_bytes"), "n_tokens", "over_limit", "cut_chars")
