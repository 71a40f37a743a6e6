"""Vectorised word and shingle hashes over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from millrace.llm.common import mix

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TABLE[_SPACE] = 0
_VALUE = _TABLE[_LOWER]  # of a byte, A-Z lower-cased, white space 0
_BASE = np.uint64(0xD1B54A32D192ED03)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(1 << int(n).bit_length(), _BASE, np.uint64)
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of the first of its words (one more at the end)."""
    full = ~_SPACE[buf]
    start = full.copy()
    start[1:] &= ~full[:-1]
    first = off[:-1][off[:-1] < len(buf)]
    start[first] = full[first]
    stop = full.copy()
    stop[:-1] &= ~full[1:] | start[1:]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, off)


def word_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of all texts, and where each text's words begin."""
    s, e, wo = word_spans(buf, off)
    if not len(s):
        return np.zeros(0, np.uint64), wo
    at = np.arange(len(buf) - s[0], dtype=np.int64) + s[0]
    at -= np.repeat(s, np.diff(np.append(s, len(buf))))
    body = buf[s[0] :]
    at[_SPACE[body]] = 0
    h = np.add.reduceat(_VALUE[body] * powers(int(at.max()) + 1)[at], s - s[0])
    return mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), wo


def shingle_hashes(h: np.ndarray, wo: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, in order, and each text's offsets.

    A text of fewer than k words has one: its whole sequence. A text without words has none.
    """
    n = np.diff(wo)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    so = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    out = np.zeros(so[-1], np.uint64)
    if not so[-1]:
        return out, so
    at = np.arange(so[-1]) - np.repeat(so[:-1], count) + np.repeat(wo[:-1], count)
    step = powers(k + 2)
    pad = np.concatenate([h, np.zeros(k, np.uint64)])
    size = np.repeat(np.minimum(n, k), count)
    for j in range(k):
        out += np.where(j < size, pad[at + j], np.uint64(0)) * step[j + 1]
    return mix(out + size.astype(np.uint64)), so


def distinct(sh: np.ndarray, so: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text."""
    doc = np.repeat(np.arange(len(so) - 1), np.diff(so))
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return sh[keep], np.searchsorted(doc[keep], np.arange(len(so)))
