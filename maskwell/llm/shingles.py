"""Word shingles, their MinHash signatures, and exact checks of candidate pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import saved
from maskwell.llm.graph import components

REMEMBERED = 300_000
STEP = 1024
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_JOIN = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value
        return value


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct hashes of `width` words in a row, sorted; of all words where there are fewer."""
    return np.unique(shingles(words, width, hashes))


def shingles(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The same in the order of the words, with repeats."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(h))
    n = len(h) - width + 1
    s = np.full(n, width, np.uint64)
    for i in range(width):
        s = s * _JOIN + h[i : i + n]
        s ^= s >> np.uint64(29)
    s *= _MIX
    s ^= s >> np.uint64(32)
    return s


class MinHash:
    """`count` minimum hashes of 32 bits."""

    def __init__(self, count: int, seed: int = 7):
        random = np.random.default_rng(seed)
        self.flip = random.integers(0, 1 << 63, count, np.uint64)[None, :]
        self.times = (random.integers(0, 1 << 62, count, np.uint64) * np.uint64(2) + np.uint64(1))[None, :]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(s), STEP):
            h = ((s[at : at + STEP, None] ^ self.flip) * self.times).min(axis=0)
            low = h if low is None else np.minimum(low, h)
        return (low >> np.uint64(32)).astype(np.uint32)

    def of_each(self, sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The minimum hashes, one row each, of the parts of `sets` that begin at `begin`; none may be empty."""
        low = np.empty((self.flip.shape[1], len(begin)), np.uint64)
        ends = np.append(begin, len(sets))
        one = 0
        while one < len(begin):
            # One hash of many sets at a time: plain arrays, which stay in the cache.
            two = max(one + 1, int(np.searchsorted(ends, ends[one] + 16 * STEP, "right")) - 1)
            part, own = sets[ends[one] : ends[two]], begin[one:two] - begin[one]
            h = np.empty_like(part)
            for flip, times, out in zip(self.flip[0], self.times[0], low, strict=True):
                np.bitwise_xor(part, flip, out=h)
                np.multiply(h, times, out=h)
                np.minimum.reduceat(h, own, out=out[one:two])
            one = two
        return (low >> np.uint64(32)).astype(np.uint32).T


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the sets share at least `percent` of their union."""
    low, high = sorted((len(a), len(b)))
    if not low or 100 * low < percent * high:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) are similar, judged on their full sets."""
    kind = dict(pairs.dtypes)["a"]
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            a, b, ta, tb = batch.columns
            keep, last, own = [], None, None
            for x, y in zip(ta.to_pylist(), tb.to_pylist(), strict=True):
                if x != last:
                    last, own = x, shingle_set(words_of(x), width, hashes)
                keep.append(similar(own, shingle_set(words_of(y), width, hashes), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    # Texts are never broadcast, whatever their size: the plan is the same for every input.
    joined = pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "ta", "tb")
    return joined.mapInArrow(judge, f"a {kind}, b {kind}")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components."""
    left = found.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    right = found.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def linked_components(
    candidates: DataFrame,
    texts: DataFrame,
    width: int,
    percent: int,
    rest: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components (id, component) of the candidate pairs (a, b, n) that are similar.

    Every candidate pair is either judged or lies inside a component already: first each node's most
    frequent partner is judged, then the pairs that the links so found leave apart. `rest` gives further
    pairs (a, b) from the components found, which are judged last.
    """
    pairs = saved(candidates)
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    some = saved(texts.join(ids.hint("merge"), "id", "left_semi"))
    likely = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("best")).select(F.col("best.a").alias("a"), "b")
    links = saved(verified(likely, some, width, percent))
    found = saved(components(links))
    others = pairs.join(likely, ["a", "b"], "left_anti").select("a", "b")
    more = saved(verified(_apart(others, found), some, width, percent))
    if not more.isEmpty():
        links = links.unionByName(more)
        found = saved(components(links))
    if rest is None:
        return found
    last = saved(_apart(rest(found), found).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if last.isEmpty():
        return found
    # Their texts are among those that the forest has met.
    links = links.unionByName(saved(verified(last, some, width, percent)))
    return saved(components(links))
