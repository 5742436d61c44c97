"""Words of many texts at once as 64-bit hashes, by Karp-Rabin prefix hashes over their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
GRAM_BASE = np.uint64(0x9E3779B97F4A7C15)

_word_byte = np.zeros(256, bool)
for _range in (range(ord("0"), ord("9") + 1), range(ord("A"), ord("Z") + 1), range(ord("a"), ord("z") + 1), range(128, 256)):
    _word_byte[list(_range)] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Each hash with its bits spread (the finalizer of MurmurHash3)."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_hashes(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, the number of words of each text, and the words' places.

    Places count bytes of the texts joined by one space. With ``prefixes`` the hashes have a column for the
    word and one for its first k bytes for each k, 0 where the word is not longer than that.

    A word is a run of ASCII letters and digits and of bytes from 128 on. The arrays are about 40 times
    the bytes, so callers pass a few hundred kilobytes at once.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = np.concatenate([[False], _word_byte[data]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[0::2], change[1::2]
    prefix = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)), dtype=np.uint64)])
    inverse = _powers(INVERSE, len(data))[starts]
    hashes = mixed((prefix[ends] - prefix[starts]) * inverse)
    if prefixes:
        parts = [hashes]
        for k in prefixes:
            part = mixed((prefix[np.minimum(starts + k, ends)] - prefix[starts]) * inverse + np.uint64(k))
            parts.append(np.where(ends - starts > k, part, np.uint64(0)))
        hashes = np.stack(parts, axis=1)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, bounds)), starts


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * GRAM_BASE + words[k:k + n]
    return mixed(out)
