"""Hashed words and shingle sets of texts, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A-Z to a-z, nothing else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RANDOM = np.random.default_rng(20240229)
#: A random number for each byte and an odd base: words are polynomials over 2^64, then mixed.
OF_BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
#: Bytes of text taken together.
AT_ONCE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (a finalizer of public hash functions)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) over 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), np.uint64)
        have[1:] = base
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def word_hashes(data: bytes, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word, between blanks (those of the 256 bytes that ``blank`` marks), of UTF-8 text."""
    own = np.frombuffer(data, np.uint8)
    if not len(own):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~blank[own]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(own) + 1, np.uint64)
    np.cumsum(OF_BYTE[own] * powers(BASE, len(own)), out=total[1:])
    return mix((total[end] - total[start]) * powers(UNBASE, len(own))[start] + (end - start).astype(np.uint64)), start


def shingle_sets(texts: list[str | None], width: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; with fewer words than ``width``, one of all words; without words none."""
    at = 0
    while at < len(texts):
        some, size = [], 0
        while at < len(texts) and (not some or size < AT_ONCE):
            data = (texts[at] or "").encode("utf-8", "surrogatepass")
            some.append(data.translate(LOWER) if lower else data)
            size += len(some[-1]) + 1
            at += 1
        hashes, start = word_hashes(b"\n".join(some))
        bounds = np.searchsorted(start, np.cumsum([0] + [len(x) + 1 for x in some])).tolist()
        rolled = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(BASE) + hashes[k : k + len(rolled)]
        rolled = mix(rolled)
        for a, b in zip(bounds, bounds[1:], strict=False):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.uint64(0x5851F42D4C957F2D)
                with np.errstate(over="ignore"):
                    for h in hashes[a:b]:
                        whole = whole * np.uint64(BASE) + h
                yield mix(np.array([whole + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
