"""Words of many texts at once: where they stand and their hashes, from the bytes of an Arrow column.

A word is a run of anything but ASCII white space, A-Z count as a-z. A hash is a sum of random numbers, one for each
byte value, times powers of an odd number, so the hashes of all words come from one running sum. Texts are taken a few
at a time, as many as `AT_ONCE` bytes hold, one at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of the texts that are cut at a time, and of a running sum.
AT_ONCE, BLOCK = 1 << 20, 1 << 16
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_TIMES = 0x9E3779B97F4A7C15

#: A-Z as a-z, white space as a blank.
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0x41:0x5B] += 0x20
PLAIN[SPACE] = 0x20
_VALUE = np.random.default_rng(11).integers(0, 1 << 64, 256, np.uint64)[PLAIN]
_VALUE[SPACE] = 0


def _powers(factor: int) -> np.ndarray:
    out = np.full(2 * BLOCK, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_TIMES), _powers(pow(_TIMES, -1, 1 << 64))


class Words:
    """The words of some texts that stand one after the other in `raw`; text i begins at byte `begin[i]`."""

    def __init__(self, raw: np.ndarray, begin: np.ndarray):
        self.raw, self.begin = raw, begin
        inside = np.concatenate([[False], ~SPACE[raw], [False]])
        starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        # Texts touch, words of two texts do not.
        starts[begin] = inside[begin + 1]
        ends[begin] = inside[begin]
        self.start, self.end = np.nonzero(starts)[0], np.nonzero(ends)[0]
        self.text = np.searchsorted(begin[:-1], self.start, "right") - 1
        self._points = None

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        cuts = np.searchsorted(self.start, np.arange(0, len(self.raw) + BLOCK, BLOCK))
        for k in range(len(cuts) - 1):
            own = slice(cuts[k], cuts[k + 1])
            at = k * BLOCK
            part = _VALUE[self.raw[at : at + 2 * BLOCK]]
            part *= _UP[: len(part)]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
            one, two = self.start[own] - at, np.minimum(self.end[own] - at, len(part))
            out[own] = (total[two] - total[one]) * _DOWN[one]
        for i in np.nonzero(self.end - self.start > BLOCK)[0]:
            out[i] = xxhash.xxh64_intdigest(PLAIN[self.raw[self.start[i] : self.end[i]]].tobytes())
        out ^= out >> np.uint64(32)
        out *= _MIX
        out ^= out >> np.uint64(29)
        return out

    def points(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The bytes `at` of the texts `text` as code points of their texts."""
        if self._points is None:
            self._points = np.concatenate([[0], np.cumsum((self.raw & 0xC0) != 0x80)])
        return self._points[at] - self._points[self.begin[text]]


def cut_texts(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """The number of the first text and the words of it and those after it, for all `texts` in turn; null is empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = whole.buffers()
    ends = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(whole):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + AT_ONCE, "right")) - 1)
        yield i, Words(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j


def runs_from(h: np.ndarray, at: np.ndarray | slice, width: int, factor: np.uint64, step: int = 1) -> np.ndarray:
    """Hashes of `width` values of `h`, `step` apart, from each of the places `at`."""
    s = None
    for i in range(0, width * step, step):
        own = h[at.start + i : at.stop + i] if isinstance(at, slice) else h[at + i]
        s = np.full(len(own), width, np.uint64) if s is None else s
        s *= factor
        s += own
        s ^= s >> np.uint64(29)
    s *= factor
    return s ^ (s >> np.uint64(32))
