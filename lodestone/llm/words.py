"""Hashes of words and of runs of words, taken from UTF-8 bytes many documents at a time."""

from __future__ import annotations

import numpy as np

from .common import mix, randoms

#: [\x20\x09-\x0D] part words; A-Z count as a-z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = randoms(256, 11)
_PLACES = randoms(64, 12)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64, n of them; kept up to a million."""
    if n > 1 << 20:
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each document's words start among them (n + 1 numbers)."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | begins[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begins[1:-1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[data]] * _power("base", _BASE, len(data)), dtype=np.uint64, out=sums[1:])
    got = (sums[last] - sums[first]) * _power("inverse", _INVERSE, len(data))[first] if len(first) else np.empty(0, np.uint64)
    return mix(got + (last - first).astype(np.uint64)), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each document's distinct k-word shingles as sorted hashes; a shorter document's whole sequence is one; no word, no shingle."""
    words, at = word_hashes(data, offsets)
    n = len(words)
    runs = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        runs += words[j : j + len(runs)] * _PLACES[j % 64] if j < 64 else mix(words[j : j + len(runs)] + np.uint64(j))
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
