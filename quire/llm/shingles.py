"""Hashes of words and of word shingles, for whole batches of texts at once in numpy.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z is lower-cased. Both rules touch single-byte characters only, so they hold on UTF-8 as
they do on code points. A word's hash is a polynomial over its bytes modulo 2**64, cut out of running sums and scrambled; a
shingle's hash combines the hashes of its words in order.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.random.default_rng(20240607).integers(1, 1 << 63, size=16, dtype=np.uint64) * _U(2) + _U(1)
_LETTER = np.random.default_rng(20240608).integers(1, 1 << 63, size=256, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: For bags of words: whatever is not a letter, a digit or part of a longer character.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of them."""
    global _powers, _inverses
    if len(_powers) < n:
        n = 1 << int(n - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _BASE, dtype=np.uint64)]))
            _inverses = np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _INVERSE, dtype=np.uint64)]))
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit integers one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(texts: list[bytes], between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words in order, and for each text the place of its first word, with the total at the end."""
    joined = b" ".join(texts)
    buffer = np.frombuffer(joined, dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    gap = np.concatenate([[True], between[buffer], [True]]).astype(np.int8)
    edge = np.diff(gap)
    begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverses = _tables(len(buffer) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buffer) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[buffer] * powers[: len(buffer)], out=sums[1:])
        hashes = mix((sums[ends] - sums[begins]) * inverses[begins] + (ends - begins).astype(np.uint64) * _STEPS[15])
    return hashes, np.searchsorted(begins, offsets)


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles: of its whole sequence if it has fewer words, none without words."""
    hashes, first = word_hashes(texts)
    n = len(hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - words + 1, 0), dtype=np.uint64)
        for k in range(words):
            rolled += hashes[k : n - words + 1 + k] * _STEPS[k] if n >= words else rolled
        rolled = mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                whole = hashes[a:b] * _STEPS[: b - a]
                out.append(mix(np.asarray([whole.sum(dtype=np.uint64) + _U(b - a) * _STEPS[14]], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out
