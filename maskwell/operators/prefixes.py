"""Longest-prefix lookups: numbers against a table of plans.

Prefixes are taken apart by length, and every length is one hash join on as many leading characters; of the lengths
that match the longest counts. A nested code therefore wins over the code that it refines. Rows are never multiplied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def longest_prefix(df: DataFrame, plans: DataFrame, value: str, prefix: str = "prefix", out: str = "plan") -> DataFrame:
    """Add ``out``, the row of ``plans`` with the longest prefix of ``value``; NULL where none fits.

    An empty prefix fits every value but NULL, a NULL prefix none. Of rows with equal prefixes the greatest counts. The
    lengths that occur, a few, are all that the driver learns of the plans.
    """
    row = F.struct(*plans.columns)
    given = plans.where(F.col(prefix).isNotNull()).groupBy(F.col(prefix).alias("p")).agg(F.max(row).alias("plan"))
    lengths = [r.n for r in given.select(F.length("p").alias("n")).distinct().orderBy(F.desc("n")).collect()]
    found, names = df, []
    for n in lengths:
        name = f"_plan_{n}"
        while name in df.columns:
            name = "_" + name
        own = given.where(F.length("p") == n).select(F.col("p").alias(f"{name}_key"), F.col("plan").alias(name))
        fits = (F.left(F.col(value), F.lit(n)) == F.col(f"{name}_key")) & (F.length(F.col(value)) >= n)
        found = found.join(own, fits, "left").drop(f"{name}_key")
        names.append(name)
    nothing = F.lit(None).cast(dict(given.dtypes)["plan"])
    return found.withColumn(out, F.coalesce(*names, nothing)).select(*[c for c in df.columns if c != out], out)
