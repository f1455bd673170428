"""Candidate pairs from sorted signature orders (an LSH forest).

A row is a key, a sequence of 32-bit levels, and an id. Rows are range-partitioned and sorted by key and id;
keys that share many levels become neighbours. Where up to `small` rows share the first `first` levels, all of
them are candidates of one another. A larger region is split by further levels, each part as deep as it
needs, and rows that stand next to each other stay candidates. Where more than `small` rows share the whole key,
each is a candidate of the row before it and of the first one: a linear number of pairs, however many
rows share the key. Ranges split such runs, too, so no task gets one whole. The rows at both ends of every
range meet in one small task, a fixed number for each range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import saved


def pair_rows(keys: np.ndarray, first: int, small: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of candidate pairs among sorted rows of levels."""
    n, levels = keys.shape
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shared = np.cumprod(keys[1:] == keys[:-1], axis=1, dtype=np.int8).sum(1)
    near = np.nonzero(shared >= first)[0]
    a, b = [near], [near + 1]
    done = np.zeros(n, bool)
    for depth in range(first, levels + 1):
        run = np.concatenate([[0], np.cumsum(shared < depth)])
        size = np.bincount(run)[run]
        own = (size > 1) & (size <= small) & ~done
        for step in range(2, small):
            if step >= n:
                break
            at = np.nonzero(own[:-step] & (run[:-step] == run[step:]))[0]
            a.append(at)
            b.append(at + step)
        done |= size <= small
        if done.all():
            break
    else:
        start = np.concatenate([[0], np.nonzero(np.diff(run))[0] + 1])[run]
        at = np.nonzero(~done & (start < np.arange(n)))[0]
        a.append(start[at])
        b.append(at)
    return np.concatenate(a), np.concatenate(b)


def candidates(rows: DataFrame, levels: int, first: int, small: int = 8) -> DataFrame:
    """Distinct pairs (a, b), a < b, with `n` the number of times they met, from rows (key binary, id)."""
    kind = dict(rows.dtypes)["id"]

    def found(table: pa.Table) -> tuple[pa.Array, pa.Array]:
        table = table.combine_chunks()
        raw = table.column("key").to_pylist()
        keys = np.frombuffer(b"".join(raw), ">u4").reshape(len(raw), levels)
        ids = table.column("id")
        i, j = pair_rows(keys, first, small)
        return ids.take(pa.array(i)), ids.take(pa.array(j))

    def flat(x: pa.ChunkedArray | pa.Array) -> pa.Array:
        return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        a, b = found(table)
        ends = pa.concat_tables([table.slice(0, small), table.slice(max(small, len(table) - small))])
        none = pa.nulls(len(a), pa.binary())
        for x, y, key in ((flat(a), flat(b), none), (flat(ends["id"]), pa.nulls(len(ends), ends["id"].type), flat(ends["key"]))):
            for at in range(0, len(x), 50_000):
                yield pa.RecordBatch.from_arrays([v.slice(at, 50_000) for v in (x, y, key)], names=["a", "b", "key"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            a, b = found(pa.Table.from_batches(parts))
            yield pa.RecordBatch.from_arrays([flat(a), flat(b)], names=["a", "b"])

    sorted_rows = rows.select("key", "id").repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    scanned = saved(sorted_rows.mapInArrow(scan, f"a {kind}, b {kind}, key binary"))
    ends = scanned.filter("key IS NOT NULL").select("key", F.col("a").alias("id")).distinct()
    stitched = ends.coalesce(1).sortWithinPartitions("key", "id").mapInArrow(stitch, f"a {kind}, b {kind}")
    return (
        scanned.filter("key IS NULL")
        .select("a", "b")
        .unionByName(stitched)
        .filter(F.col("a") != F.col("b"))
        .groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(F.count("*").alias("n"))
    )
