"""Stretches of words that stand in more than one place, wherever they lie in a text.

A stretch is made of windows of `SPAN` words (A-Z lower-cased, line ends are white space), each of which stands in two
places at least, of one text or of several. Which windows of a text are looked at follows from its words alone
(winnowing): of every `LENGTH - SPAN + 1` shingles in a row the one with the least hash starts a window. So whatever
`LENGTH` words stand in two places, both hold the same window at the same place, and it is found. A window costs one
row for about fourteen words, and no texts are compared.

Windows are equal when their digests of 128 bits are. They are counted where they are before they are moved, so a
window that many texts hold is no burden. Repeated windows that overlap or touch in a text are one stretch. A window
starts at least every `LENGTH - SPAN + 1` words (`SPAN` or fewer, so what repeats as a whole is one stretch); a
stretch may lack fewer than that many words at both ends of what is repeated, and holds no others. Stretches with a window in common are one cluster (components over the digests of first
windows, so equal stretches are one node). The first by document id and place stays, the others are removals.
After the count, copies of a text are one text.

Defined results: null and empty texts and those with fewer than `LENGTH` words have no stretch; a null document
id takes no part; rows that repeat an id and a text are copies; an id with two texts has the stretches of both;
windows that overlap or touch their own copies (a word over and over) are one stretch, alone in its cluster and not removed.
Columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwell.llm.common import saved
from maskwell.llm.graph import components
from maskwell.llm.wordruns import cut_texts, runs_from

#: Words in a row that are found wherever they repeat, words of a window, words of a shingle.
LENGTH, SPAN, WIDTH = 51, 26, 5
#: Shingles and output rows worked on at a time.
STEP = 50_000
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Bits that hold a place among `STEP` shingles and those behind them.
_PLACE = np.uint64((1 << 20) - 1)


def anchors(h: np.ndarray, length: int, span: int, text: np.ndarray | None = None, width: int = WIDTH) -> np.ndarray:
    """Places of the least shingle of every `length - span + 1` in a row, the first of equal ones.

    `text` tells the text of every word, in order; where it is absent all words are of one. Shingles are compared by
    their upper 44 bits.
    """
    reach = length - span + 1
    if len(h) < length:
        return np.zeros(0, np.int64)
    text = np.zeros(len(h), np.int64) if text is None else text
    s = runs_from(h, slice(0, len(h) - width + 1), width, _FACTORS[0])
    enough = np.bincount(text)[text] >= length
    least = []
    for at in range(0, len(s) - reach + 1, STEP):
        low = s[at : at + STEP + reach - 1] & ~_PLACE
        low |= np.arange(len(low), dtype=np.uint64)
        # The least of 1, 2, 4 ... in a row, at last of `reach`.
        held = 1
        while held < reach:
            more = min(held, reach - held)
            low = np.minimum(low[:-more], low[more:])
            held += more
        here = np.arange(at, at + len(low))
        own = enough[here] & (text[here] == text[here + reach + width - 2])
        least.append((low[own] & _PLACE).astype(np.int64) + at)
    found = np.concatenate(least)
    # Places never fall from one row of shingles to the next.
    found = found[np.diff(found, prepend=-1) > 0]
    found = found[found + span <= len(h)]
    return found[text[found] == text[found + span - 1]]


def digests_of(h: np.ndarray, at: np.ndarray, span: int, width: int = WIDTH) -> list[np.ndarray]:
    """Two hashes of the `span` words from each of the places `at`, from shingles that cover them."""
    if not len(at) or span < width:
        return [runs_from(h, at, span, f) for f in _FACTORS]
    out = []
    for one, two in (_FACTORS, _FACTORS[::-1]):
        s = runs_from(h, slice(0, len(h) - width + 1), width, one)
        # The last shingle may overlap the one before it.
        whole = runs_from(s, at, span // width, two, width)
        out.append(runs_from(np.stack([whole, s[at + span - width]]).T.reshape(-1), np.arange(0, 2 * len(at), 2), 2, two))
    return out


def windows(texts: DataFrame, length: int, span: int) -> DataFrame:
    """of, at (first word), start, end (code points), digest for every chosen window of the texts of (of, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, words in cut_texts(batch.column(1)):
                h = words.hashes()
                found = anchors(h, length, span, words.text)
                for k in range(0, len(found), STEP):
                    at = found[k : k + STEP]
                    text = words.text[at]
                    place = at - np.searchsorted(words.text, text)
                    start, end = words.points(words.start[at], text), words.points(words.end[at + span - 1], text)
                    both = np.stack(digests_of(h, at, span), axis=1)
                    digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(both), [None, pa.py_buffer(both.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(first + text)),
                            *(pa.array(c.astype(np.int32)) for c in (place, start, end)),
                            digest.cast(pa.binary()),
                        ],
                        names=["of", "at", "start", "end", "digest"],
                    )

    return texts.select("of", "text").mapInArrow(run, "of binary, at int, start int, end int, digest binary")


def repeated_stretches(docs: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """Every stretch: doc_id, start, end (code points), n_words, cluster_doc_id, cluster_start (of the one that
    stays), n_members, removed."""
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.unhex(F.md5("text")).alias("of"), "doc_id", "text")
    known = saved(named.select("of", "doc_id"))
    classes = known.groupBy("of").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    found = saved(windows(named, length, span))
    again = found.groupBy("digest").agg(F.count("*").alias("places")).filter("places > 1").select("digest")
    inside = found.join(again, "digest", "left_semi").distinct()

    order = Window.partitionBy("of").orderBy("at")
    begins = F.when(F.col("at") - F.lag("at").over(order) <= span, 0).otherwise(1)
    islands = inside.withColumn("begins", begins).withColumn("island", F.sum("begins").over(order))
    first = F.first("digest").over(Window.partitionBy("of", "island").orderBy("at"))
    islands = saved(islands.withColumn("first", first).drop("begins"))
    spans = islands.groupBy("of", "island", "first").agg(
        F.min("start").cast("bigint").alias("start"),
        F.max("end").cast("bigint").alias("end"),
        (F.max("at") - F.min("at") + span).cast("bigint").alias("n_words"),
    )
    held = islands.select("first", "digest").distinct()
    shared = held.groupBy("digest").agg(F.min("first").alias("b"), F.max("first").alias("high")).filter("b < high").drop("high")
    linked = components(held.join(shared, "digest").select(F.col("first").alias("a"), "b").distinct())
    clustered = (
        spans.join(linked, F.col("first") == F.col("id"), "left")
        .select("of", "start", "end", "n_words", F.coalesce("component", "first").alias("cluster"))
    )
    clustered = saved(clustered)
    counted = clustered.join(classes, "of").groupBy("cluster").agg(
        F.sum("n").alias("n_members"), F.min(F.struct("low", "start")).alias("stays")
    )
    placed = clustered.join(counted, "cluster").select(
        F.col("of").alias("class"), "start", "end", "n_words", F.col("stays.low").alias("cluster_doc_id"),
        F.col("stays.start").alias("cluster_start"), "n_members",
    )
    out = known.join(placed, F.col("of") == F.col("class")).drop("of", "class")
    stays = (F.col("doc_id") == F.col("cluster_doc_id")) & (F.col("start") == F.col("cluster_start"))
    return out.withColumn("removed", ~stays)
