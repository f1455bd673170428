"""Connected components of a link table, by alternating stars.

Links point from the larger to the smaller end. A large star ties every larger neighbour of a node to the
smallest node around it, a small star does so with the smaller ones; both keep components whole. They
alternate until nothing changes: every node then points to its component's smallest. Each round is two
aggregations and joins over the links, which shrink; results are written to the shared folder.
No node's links are ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwell.llm.common import saved


def _stars(links: DataFrame) -> DataFrame:
    back = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    both = links.unionByName(back)
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    large = (
        both.filter(F.col("v") > F.col("u"))
        .join(lowest, F.col("u") == F.col("n"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = (
        large.join(lowest.select(F.col("u").alias("n"), "m"), F.col("u") == F.col("n"))
        .filter(F.col("v") != F.col("m"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return moved.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of links (a, b): the smallest node it is connected to.

    Links of a node with itself or with null are ignored; repeated ones count once. Nodes without a link
    do not appear. Ends may be of any type that has an order.
    """
    now = saved(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        # A count and a digest tell whether a round changed anything.
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before or state[0] == 0:
            break
        before, now = state, saved(_stars(now))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
