"""Passages that repeat across documents, by MinHash bands over paragraphs.

A document's paragraphs are its lines. Those of at least `MIN_WORDS` words are sets of shingles of five words. Equal
sequences of words are one class, found by digest. Classes are banded: `BANDS` bands of `ROWS` minimum hashes, so
that two paragraphs of similarity 0.8 share a band with probability 0.9998. Classes with a band in common become
candidates (see `forest`: all of them in small bands, chains and stars in large ones), are judged by the exact
similarity of their sets, and linked ones form clusters. What these links leave apart in a large band is paired
as op7 does it (see `neardup.late_pairs`), so that every two classes with a band in common are judged, connected
or proven apart. In a cluster with more than one paragraph the first
one, by document id and place, stays; the others are removals. Passages inside longer lines or over several
lines are found as stretches of equal words (see `stretches`), which the query returns beside the paragraphs.

Defined results: null and empty texts and shorter lines have no paragraphs here; with fewer words than a shingle a
paragraph would be one shingle; a null document id takes no part; a paragraph that repeats within
one document counts like any other; rows that repeat an id repeat its paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import saved, table
from maskwell.llm.forest import candidates
from maskwell.llm.neardup import late_pairs
from maskwell.llm.shingles import MinHash, linked_components
from maskwell.llm.stretches import repeated_stretches
from maskwell.llm.wordruns import PLAIN, cut_texts, runs_from

MIN_WORDS = 25
BANDS, ROWS = 16, 4
WIDTH, PERCENT = 5, 80
#: Classes of a band that are all paired at once.
SMALL = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def sets_of(h: np.ndarray, first: np.ndarray, n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of the lines of `n_words` words from `first`, one line after the other, and where each line's begin."""
    n = np.maximum(n_words - width + 1, 1)
    begin = np.cumsum(n) - n
    at = np.arange(n.sum()) + np.repeat(first - begin, n)
    if n_words.min() >= width:
        return runs_from(h, slice(0, len(h) - width + 1), width, _FACTOR)[at], begin
    out = np.empty(len(at), np.uint64)
    size = np.repeat(np.minimum(n_words, width), n)
    for own in np.unique(size):
        out[size == own] = runs_from(h, at[size == own], int(own), _FACTOR)
    return out, begin


def bands_of(low: np.ndarray) -> pa.Array:
    """One value of 64 bits for each band, joined, from rows of minimum hashes."""
    keys = runs_from(np.ascontiguousarray(low).astype(np.uint64).reshape(-1), np.arange(0, low.size, ROWS), ROWS, _FACTOR)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * BANDS), len(low), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def paragraphs(docs: DataFrame, min_words: int, width: int) -> DataFrame:
    """doc_id, place, start, end (code points), n_words, digest, bands for every paragraph."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = MinHash(BANDS * ROWS, seed=9)
        for batch in batches:
            for text, words in cut_texts(batch.column(1)):
                breaks = np.nonzero(words.raw == 0x0A)[0]
                before = np.searchsorted(breaks, words.start)
                first = np.nonzero(np.diff(before + words.text, prepend=-1))[0]
                size = np.diff(first, append=len(before))
                first, size = first[size >= min_words], size[size >= min_words]
                if not len(first):
                    continue
                of, line = words.text[first], before[first]
                low = np.maximum(words.begin[of], np.append(-1, breaks)[line] + 1)
                high = np.minimum(words.begin[of + 1], np.append(breaks, len(words.raw))[line])
                plain = PLAIN[words.raw].tobytes()
                from_, to = words.start[first], words.end[first + size - 1]
                total = np.concatenate([[0], np.cumsum(words.end - words.start)])
                letters = total[first + size] - total[first]
                # Most words stand one blank apart already.
                joined = (
                    plain[a:b] if b - a == n else b" ".join(plain[a:b].split())
                    for a, b, n in zip(from_.tolist(), to.tolist(), (letters + size - 1).tolist(), strict=True)
                )
                sets, begin = sets_of(words.hashes(), first, size, width)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(text + of)),
                        pa.array(line - np.searchsorted(breaks, words.begin[of])),
                        pa.array(words.points(low, of)),
                        pa.array(words.points(high, of)),
                        pa.array(size),
                        pa.array(map(xxhash.xxh3_128_digest, joined), pa.binary()),
                        bands_of(sign.of_each(sets, begin)),
                    ],
                    names=["doc_id", "place", "start", "end", "n_words", "digest", "bands"],
                )

    schema = f"doc_id {kind}, place bigint, start bigint, end bigint, n_words bigint, digest binary, bands binary"
    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, schema)


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Every paragraph whose cluster has another: doc_id, place, start, end, n_words, cluster_doc_id,
    cluster_place (the one that stays), n_members, removed."""
    found = saved(paragraphs(docs, min_words, width))
    classes = saved(
        found.groupBy("digest").agg(
            F.min(F.struct("doc_id", "place", "start", "end", "bands")).alias("first"), F.count("*").alias("n")
        )
    ).select(F.col("digest").alias("id"), "n", "first.*")
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band")
    rows = classes.select("id", "bands", band).select(
        F.concat(F.unhex(F.lpad(F.hex("band"), 8, "0")), F.expr("substring(bands, band * 8 + 1, 8)")).alias("key"), "id"
    )
    # Most bands are held by one class only: they pair nothing, and go before rows are sorted and kept.
    met = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    rows = saved(rows.join(met, "key", "left_semi"))
    pairs = saved(candidates(rows, 3, 3, SMALL))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    source = docs.select(F.col("doc_id").alias("of"), "text")
    texts = saved(
        classes.join(ids, "id", "left_semi")
        .select("id", "doc_id", "start", "end")
        .join(source.hint("merge"), F.col("doc_id") == F.col("of"))
        .select("id", F.expr("substring(text, int(start + 1), int(end - start))").alias("text"))
    )
    regions = rows.withColumnRenamed("key", "region")
    linked = linked_components(pairs, texts, width, percent, lambda found: late_pairs(regions, found, SMALL, texts, width, percent))
    clusters = classes.join(linked, "id", "left").select("id", "n", "doc_id", "place", F.coalesce("component", "id").alias("cluster"))
    totals = (
        clusters.groupBy("cluster")
        .agg(F.sum("n").alias("n_members"), F.min(F.struct("doc_id", "place")).alias("stays"))
        .filter("n_members > 1")
    )
    named = clusters.select("id", "cluster").join(totals, "cluster").select(
        F.col("id").alias("of"), "n_members", F.col("stays.doc_id").alias("cluster_doc_id"), F.col("stays.place").alias("cluster_place")
    )
    out = found.drop("bands").join(named, F.col("digest") == F.col("of")).drop("digest", "of")
    stays = (F.col("doc_id") == F.col("cluster_doc_id")) & (F.col("place") == F.col("cluster_place"))
    return out.withColumn("removed", ~stays)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs (`kind` paragraph, with `place`) and repeated stretches of words (`kind` stretch)."""
    docs = table(spark, sf_dir, "documents")
    lines = repeated(docs).withColumn("kind", F.lit("paragraph"))
    return lines.unionByName(repeated_stretches(docs).withColumn("kind", F.lit("stretch")), allowMissingColumns=True)
