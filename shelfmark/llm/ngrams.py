"""Hashed character n-grams of whole texts, as arrays."""

from __future__ import annotations

import numpy as np

_BASE, _MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_seen: dict[int, np.ndarray] = {}


def ngram_ids(text: str, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Distinct ids (each below 2 ** bits) of a text's n-grams of the given ascending lengths."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = _seen.setdefault(bits, np.zeros(1 << bits, np.int32))
    found, code = [], np.zeros(len(points), np.uint32)
    for n in range(1, orders[-1] + 1):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * _BASE + points[n - 1 :] + np.uint32(n)
        if n in orders:
            mixed = code ^ (code >> np.uint32(15))
            mixed *= _MIX
            found.append(mixed >> np.uint32(32 - bits))
    if not found:
        return np.empty(0, np.uint32)
    ids = np.concatenate(found)
    order = np.arange(len(ids), dtype=np.int32)
    seen[ids] = order  # of equal ids one writes last, and stands for all
    return ids[seen[ids] == order]


def pattern_ids(text: str) -> np.ndarray:
    """Distinct n-grams of four words with each word replaced by where it occurs first among the four: which of the six pairs are equal, as a number below 64."""
    words = text.split()
    if len(words) < 4:
        return np.empty(0, np.uint32)
    h = np.fromiter(map(hash, words), np.int64, len(words))
    a = [h[k : len(h) - 3 + k] for k in range(4)]
    code = np.zeros(len(h) - 3, np.uint32)
    for bit, (i, j) in enumerate(((0, 1), (1, 2), (2, 3), (0, 2), (1, 3), (0, 3))):
        code |= (a[i] == a[j]).astype(np.uint32) << np.uint32(bit)
    return np.flatnonzero(np.bincount(code, minlength=64)).astype(np.uint32)
