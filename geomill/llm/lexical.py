"""Words of letters, digits and non-ASCII characters, told apart and coded a batch of texts at a time.

Only A to Z are lower-cased.  As every byte of a non-ASCII character is 0x80
or more in UTF-8, words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geomill.llm.substring import _BYTE, _VALUES, _mix, _powers

#: Bytes of text that are coded at once.
SLICE_BYTES = 1 << 18
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_A, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x94D049BB133111EB)


@lru_cache(4)
def _factors(half: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BYTE[half], SLICE_BYTES), _powers(pow(_BYTE[half], -1, 2**64), SLICE_BYTES)


class Words:
    """The words of ``texts`` laid end to end: ``begin`` and ``stop`` in ``bytes``, ``doc`` (index of the text), ``sizes`` (words of each text)."""

    def __init__(self, texts: list[bytes | None]):
        whole = b" ".join([x or b"" for x in texts]) + b" "
        limits = np.cumsum([len(x or b"") + 1 for x in texts]) if texts else np.zeros(0, np.int64)
        self.bytes = _LOWER[np.frombuffer(whole, np.uint8)]
        inside = _WORD[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        self.begin, self.stop = edge[::2], edge[1::2]
        self.doc = np.searchsorted(limits, self.begin, side="right")
        self.sizes = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes

    def codes(self, half: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; ``half`` 1 is a second, independent one."""
        out, at, n = np.empty(len(self.begin), np.uint64), 0, len(self.begin)
        while at < n:
            lo = self.begin[at]
            to = max(at + 1, int(np.searchsorted(self.stop, lo + SLICE_BYTES, side="right")))
            b, e = self.begin[at:to] - lo, self.stop[at:to] - lo
            values = _VALUES[half][self.bytes[lo : lo + e[-1]]]
            power, inverse = _factors(half) if len(values) <= SLICE_BYTES else (_powers(_BYTE[half], len(values)), _powers(pow(_BYTE[half], -1, 2**64), 1))
            sums = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * power[: len(values)], out=sums[1:])
            out[at:to] = _mix((sums[e] - sums[b]) * inverse[b] + (e - b).astype(np.uint64))
            at = to
        return out

    def text(self, i: int, j: int) -> list[str]:
        """Words ``i`` to ``j`` as strings."""
        return [self.bytes[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(self.begin[i:j].tolist(), self.stop[i:j].tolist())]

    def shingles(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``n`` words of one text."""
        starts = np.arange(max(0, len(codes) - n + 1))
        starts = starts[self.doc[starts] == self.doc[starts + n - 1]]
        name = np.full(len(starts), n, np.uint64)
        for k in range(n):
            name = _mix(name * _A + codes[starts + k] + _C)
        return starts, name


def word_batches(batch: pa.RecordBatch, column: str, most_bytes: int = 2 * SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """``batch`` in parts of about ``most_bytes`` bytes of ``column``, one text at least, each with its words."""
    texts = batch.column(column).cast(pa.binary())
    sizes = np.array([0 if x is None else x for x in pc.binary_length(texts).to_pylist()], np.int64)
    part = np.cumsum(sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else []
    for lo, hi in zip(cuts, cuts[1:]):
        yield batch.slice(lo, hi - lo), Words(texts.slice(lo, hi - lo).to_pylist())
