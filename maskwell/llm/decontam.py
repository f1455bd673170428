"""Benchmark decontamination: n-grams of the items seed a local alignment of documents with them.

The word pairs of the items go to every task as a sorted index, a bounded part of the items at a time. How many pairs
an accepted alignment must hold follows from the item's length and the least score (see `seed_bound`), and so does how
far gaps can shift them. Where so many stand close enough together, document and item are aligned by Smith-Waterman
over words, in that part of the document with the item's length and what gaps can add around it. Nothing is
shuffled or dropped for being common: a seed that many documents hold costs one alignment in each. The score is that of the best local alignment
divided by the item's own, so a whole copy has 1 and edits cost their share.

Words are runs of letters, digits and underscores in lower case. Defined results: a null or empty text or item
matches nothing; an item of fewer than five words is one seed; equal scores go to the alignment that ends
first; rows that repeat give repeated rows; a null document id is reported as null, items with a null id
are left out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import saved, table
from maskwell.llm.shingles import WordHashes

WIDTH = 2
#: Items with fewer words count only as a whole.
SHORT = 5
MIN_SCORE = 0.6
#: Characters of items that are sent to the tasks at a time; more items take more passes over the documents.
PART = 16_000_000
MATCH, MISMATCH, GAP = 2, -1, -1

WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams(words: list[str], width: int, hashes: WordHashes) -> np.ndarray:
    """One hash for each place where `width` words begin; of all words where there are fewer."""
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter((hashes[w.encode()] for w in words), np.uint64, len(words))
    width = min(width, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(s)]
        s ^= s >> np.uint64(29)
    return s.view(np.int64)


def seed_bound(n: int, width: int, min_score: float) -> tuple[int, int]:
    """Seed width of an item of `n` words, and how many of its seeds an accepted alignment holds at least.

    With m words matched and e edits 2 m - e >= 2 min_score n and m <= n, so e <= 2 n (1 - min_score). The matched words
    form at most e + 1 runs, which hold m - e - 1 pairs: (2 min_score - 1) n - 1 at least. Where that gives
    no pair, single words are the seeds.
    """
    if n < SHORT:
        return SHORT, 1
    pairs = math.ceil((2 * min_score - 1) * n - 1 - 1e-9)
    if width == 2 and pairs >= 1:
        return 2, pairs
    return 1, max(1, math.ceil(min_score * n - 1e-9))


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local score of the item's words in the document's, and where it begins and ends (exclusive)."""

    def sweep(d: np.ndarray, t: np.ndarray) -> tuple[int, int]:
        place = np.arange(len(d) + 1) * -GAP
        row = np.zeros(len(d) + 1, np.int64)
        best, end = 0, 0
        for word in t:
            new = np.zeros_like(row)
            new[1:] = np.maximum(row[:-1] + np.where(d == word, MATCH, MISMATCH), row[1:] + GAP)
            row = np.maximum.accumulate(np.maximum(new, 0) + place) - place
            at = int(row.argmax())
            if row[at] > best:
                best, end = int(row[at]), at
        return best, end

    score, end = sweep(doc, item)
    if not score:
        return 0, 0, 0
    _, length = sweep(doc[:end][::-1], item[::-1])
    return score, end - length, end


@dataclass
class Index:
    """The grams of some items, sorted, with the item and the place of each."""

    ids: pa.Array
    #: Words of each item by number, and each item as such numbers.
    codes: dict[str, int]
    targets: list[np.ndarray]
    #: For every width: grams, item numbers, places.
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    #: For every item: grams that an accepted alignment holds at least, and how far apart their diagonals lie at most.
    needed: np.ndarray
    reach: np.ndarray


def index_of(ids: pa.Array, texts: list[str], width: int, min_score: float) -> Index:
    hashes, codes = WordHashes(), {}
    targets, needed, reach = [], [], []
    lists: dict[int, list] = {}
    for n, text in enumerate(texts):
        words = words_of(text)
        targets.append(np.array([codes.setdefault(w, len(codes)) for w in words], np.int64))
        w, least = seed_bound(len(words), width, min_score)
        needed.append(least)
        reach.append(int(MATCH * len(words) * (1 - min_score) / -GAP + 1e-9))
        g = grams(words, w, hashes)
        lists.setdefault(min(w, len(words)), []).append((g, np.full(len(g), n), np.arange(len(g))))
    found = {}
    for w, parts in lists.items():
        g, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(g, kind="stable")
        found[w] = (g[order], item[order], at[order])
    found.pop(0, None)
    return Index(ids, codes, targets, found, np.array(needed, np.int64), np.array(reach, np.int64))


def windows(words: list[str], index: Index, hashes: WordHashes) -> Iterator[tuple[int, int, int, int]]:
    """(item number, lowest and highest diagonal, distinct grams) wherever enough grams of an item lie close together."""
    item, at, place = [], [], []
    for w, (sorted_grams, items, places) in index.grams.items():
        if len(words) < w:
            continue
        g = grams(words, w, hashes)
        low, high = np.searchsorted(sorted_grams, g, "left"), np.searchsorted(sorted_grams, g, "right")
        n = high - low
        if not n.any():
            continue
        k = np.repeat(np.arange(len(g)), n)
        pick = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        item.append(items[pick])
        at.append(places[pick])
        place.append(k)
    if not item:
        return
    item, at, place = np.concatenate(item), np.concatenate(at), np.concatenate(place)
    diagonal = place - at
    order = np.lexsort((diagonal, item))
    item, at, diagonal = item[order], at[order], diagonal[order]
    last = np.arange(len(item)) + index.needed[item] - 1
    end = np.minimum(last, len(item) - 1)
    ok = (last < len(item)) & (item[end] == item) & (diagonal[end] - diagonal <= index.reach[item])
    start = 0
    good = np.nonzero(ok)[0]
    while start < len(good):
        # Starts whose windows overlap are one.
        stop = start + 1
        own = item[good[start]]
        while stop < len(good) and item[good[stop]] == own and diagonal[good[stop]] - diagonal[good[stop - 1]] <= index.reach[own]:
            stop += 1
        low, high = diagonal[good[start]], diagonal[good[stop - 1]] + index.reach[own]
        inside = (item == own) & (diagonal >= low) & (diagonal <= high)
        distinct = len(np.unique(at[inside]))
        if distinct >= index.needed[own]:
            yield int(own), int(low), int(high), distinct
        start = stop


def aligned(text: str | None, index: Index, hashes: WordHashes, min_score: float) -> dict[int, tuple[float, int, int, int]]:
    """By item number: score, first word, end and seeds of the best alignment, where it is good enough."""
    words = words_of(text)
    best: dict[int, tuple[float, int, int, int]] = {}
    d = None
    for item, low, high, n_seeds in windows(words, index, hashes):
        if d is None:
            d = np.array([index.codes.get(w, -1) for w in words], np.int64)
        target = index.targets[item]
        # From the lowest diagonal's first word to the highest one's last, with as much again for words before the first gram.
        start = max(0, low - int(index.reach[item]))
        part = d[start : high + len(target) + int(index.reach[item])]
        if np.isin(target, part).sum() < min_score * len(target) - 1e-9:
            continue
        score, a, b = align(part, target)
        if score >= min_score * MATCH * len(target) and (item not in best or score / (MATCH * len(target)) > best[item][0]):
            best[item] = (score / (MATCH * len(target)), start + a, start + b, n_seeds)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word, n_seeds for every document and item that align well."""
    items = saved(benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text"))
    kinds = dict(docs.dtypes) | dict(items.dtypes)
    schema = (
        f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, score double, start_word bigint, end_word bigint, n_seeds bigint"
    )
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-size // PART))
    out = None
    for n in range(parts):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == n).toArrow()
        ids = part.column("item_id").combine_chunks()
        index = index_of(ids, part.column("text").to_pylist(), width, min_score)
        sent = docs.sparkSession.sparkContext.broadcast(index)
        found = docs.select("doc_id", "text").mapInArrow(aligner(sent, min_score), schema)
        out = found if out is None else out.unionByName(found)
    return out


def aligner(sent: Broadcast, min_score: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, index = WordHashes(), sent.value
        for batch in batches:
            at, item, out = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for n, row in aligned(text, index, hashes, min_score).items():
                    at.append(i)
                    item.append(n)
                    out.append(row)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    index.ids.take(pa.array(item, pa.int64())),
                    pa.array([x[0] for x in out], pa.float64()),
                    pa.array([x[1] for x in out], pa.int64()),
                    pa.array([x[2] for x in out], pa.int64()),
                    pa.array([x[3] for x in out], pa.int64()),
                ],
                names=["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"],
            )

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that align with no item."""
    gone = contaminated(docs, benchmark).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
