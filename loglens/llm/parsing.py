"""Prefix-free parsing of byte buffers with rolling-hash triggers, vectorised over many documents at a time.

A window is a string of ``width`` bytes. Its trigger is the position with the least rolling hash among those that leave
``core`` bytes within the window, the leftmost of equals, so equal windows have their triggers at equal places. A phrase
is a maximal run of window starts with one trigger; its text reaches to the end of its last window, so that neighbours
overlap and none ends within the windows of another. Every window has a trigger, and a phrase has at most
``width - core + 1`` starts. Triggers depend on nothing outside their windows, so a buffer may be cut anywhere: a phrase
at a cut is then told in two parts, which is as right as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

GRAM = 16  # bytes under the rolling hash
SLICE = 1 << 16  # window starts handled at once: bounds the memory, whatever the length of a text
_TIE_BITS = 17  # a position within a slice and its right context
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MOST = SLICE + 4096


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    factors = np.full(_MOST, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


class Hashes:
    """64-bit hashes of any substrings of a buffer, each by one subtraction of sums of bytes times powers of a base."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * _UP[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * _DOWN[start]
        return mixed(raw + (end - start).astype(np.uint64) * _MIX)

    def all(self, length: int) -> np.ndarray:
        """The hashes of all substrings of one length, in order."""
        raw = (self.sums[length:] - self.sums[:-length]) * _DOWN[: len(self.sums) - length]
        return mixed(raw + np.array([length], np.uint64) * _MIX)


def _sliding_least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` adjacent keys, from prefix and suffix minima of blocks."""
    n = len(keys) - span + 1
    padded = np.full(-(-len(keys) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def phrases(data: np.ndarray, ends: np.ndarray, width: int, core: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Phrases of concatenated documents: (document, start in the document, starts, core hash, text hash, offset of the
    trigger from the start).

    ``ends`` holds the documents' ends in ``data``. Windows lie within one document; shorter documents have none.
    """
    begins = np.concatenate([[0], ends[:-1]])
    span = width - core + 1
    ties = np.uint64((1 << _TIE_BITS) - 1)
    for low in range(0, max(0, len(data) - width + 1), SLICE):
        part = data[low : low + SLICE + width - 1]
        hashes = Hashes(part)
        n = len(part) - width + 1  # window starts in this slice
        keys = (hashes.all(GRAM)[: n + span - 1] & ~ties) | np.arange(n + span - 1, dtype=np.uint64)
        trigger = _sliding_least(keys, span) & ties
        changes = np.flatnonzero(trigger[1:] != trigger[:-1]) + 1
        near = slice(*np.searchsorted(ends, [low, low + n + width], side="right"))
        near = slice(near.start, min(near.stop + 1, len(ends)))
        opens = np.maximum(begins[near] - low, 0)  # where the documents' windows begin and end in this slice
        closes = np.minimum(ends[near] - low - width + 1, n)
        some = closes > opens
        docs, opens, closes = np.arange(near.start, near.stop)[some], opens[some], closes[some]
        cuts = np.unique(np.concatenate([changes, opens, closes]))
        cuts = cuts[cuts < n]
        which = np.searchsorted(opens, cuts, side="right") - 1
        inside = (which >= 0) & (cuts < closes[which]) if len(docs) else np.zeros(len(cuts), bool)
        first, which = cuts[inside], which[inside]
        if not len(first):
            continue
        ahead = np.append(cuts[1:], n)[inside]
        count = ahead - first
        doc = docs[which]
        where = trigger[first].astype(np.int64)
        yield (
            doc,
            first + low - begins[doc],
            count,
            hashes.of(where, where + core),
            hashes.of(first, first + count + width - 1),
            where - first,
        )


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of the window at every start of a buffer of at most a slice."""
    return Hashes(data).all(width)
