"""Interval joins for spans in row form.

Whether a span lies inside a range of its document is decided without pairing them: among the ranges that start at or
before the span, the one that reaches farthest decides. That is a running maximum over ranges and spans in order of
place. Documents are cut into tiles, so a long one is spread over tasks; what reaches into a tile from the tiles
before it is carried over as one row. Every range and span appears once, however far a range reaches and however many
overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a tile.
TILE = 65_536


def with_reach(
    spans: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("doc_id",), out: str = "reach",
    start: str = "start", end: str = "end", payload: Sequence[str] = (), tile: int = TILE,
) -> DataFrame:
    """Add ``out`` to every span: of the ranges of its document that start at or before it, the farthest end.

    ``out`` is ``struct<end, payload...>`` and NULL where no range starts before; of ranges with equal ends the greatest
    payload counts. The places of a span are in ``start``, those of a range in the columns named. Spans without a
    start or a key have no ranges, ranges without one are ignored. Every span stays, repeats included.
    """
    key = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    reach = F.struct(F.col(end).alias("end"), *(F.col(c).alias(f"p{i}") for i, c in enumerate(payload)))
    given = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *key, F.col(start).cast("long").alias("at"), F.lit(1).alias("what"), reach.alias("reach")
    )
    reached = dict(given.dtypes)["reach"]
    asked = spans.select(
        *key, F.col("start").cast("long").alias("at"), F.lit(2).alias("what"),
        F.lit(None).cast(reached).alias("reach"), F.struct(*spans.columns).alias("span"),
    )
    given = given.withColumn("span", F.lit(None).cast(dict(asked.dtypes)["span"]))
    rows = given.unionByName(asked).withColumn("tile", F.floor(F.col("at") / tile))

    before = Window.partitionBy(*names).orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = rows.groupBy(*names, "tile").agg(F.max("reach").alias("own"))
    carried = tiles.select(*names, "tile", F.max("own").over(before).alias("reach")).where(F.col("reach").isNotNull())
    carried = carried.select(
        *names, (F.col("tile") * tile).alias("at"), F.lit(0).alias("what"), "reach",
        F.lit(None).cast(dict(asked.dtypes)["span"]).alias("span"), "tile",
    )
    so_far = (
        Window.partitionBy(*names, "tile").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = [F.col(n).isNotNull() for n in (*names, "at")]
    sure = known[0]
    for test in known[1:]:
        sure = sure & test
    joined = rows.unionByName(carried).withColumn("reach", F.max("reach").over(so_far)).where("what = 2")
    named = F.struct(F.col("reach.end").alias("end"), *(F.col(f"reach.p{i}").alias(c) for i, c in enumerate(payload)))
    return joined.select(
        *(F.col("span")[c].alias(c) for c in spans.columns),
        F.when(sure & F.col("reach").isNotNull(), named).alias(out),
    )


def drop_contained(spans: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("doc_id",), tile: int = TILE) -> DataFrame:
    """Spans that lie wholly inside a range of their document go, in row form; all others stay as they are."""
    out = "_reach"
    while out in spans.columns:
        out = "_" + out
    inside = F.col(out)["end"] >= F.col("end")
    return with_reach(spans, ranges, keys, out, tile=tile).where(~F.coalesce(inside, F.lit(False))).drop(out)
