"""Rows to shards by a weighted hash tree: region, rack, shard.

Every node of the tree has a weight, the sum of those below. A row descends: at each level it draws one
number per child from a hash of the row's id and the child's name, divides its exponential draw by the
child's weight and goes to the smallest. A child's share is its weight's share. When a weight changes,
only draws against that node change, so rows move into or out of that subtree and nowhere else. Growth
puts each new shard into a region of its own: at the top one more child draws, the rows it wins go to
it, and nothing below any other region changes.

Defined results: a null id draws as the word null; a null text has size 1 and checksum 0; repeated rows
share a shard and get slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import table

#: Shards of the base tree: two regions of two racks of four.
BASE, PER_RACK, PER_REGION = 16, 4, 8


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n: int) -> list[Shard]:
    """The tree of n shards. From the 17th on, each shard brings a region of its own."""
    if n < 1:
        raise ValueError("at least one shard")
    base = [Shard(f"r{i // PER_REGION}", f"k{i // PER_RACK}", i) for i in range(min(n, BASE))]
    return base + [Shard(f"g{i}", f"g{i}", i) for i in range(BASE, n)]


def _children(tree: list[Shard]) -> list[list[tuple[str, float, int]]]:
    """For every node, the name, weight and number of each child: the root is 0, shard s is -1 - s."""
    live = [s for s in tree if s.weight > 0]
    out: list[list[tuple[str, float, int]]] = [[]]
    numbers: dict[tuple[str, ...], int] = {(): 0}
    for level in (("region",), ("region", "rack")):
        groups: dict[tuple[str, ...], float] = {}
        for s in live:
            path = tuple(getattr(s, x) for x in level)
            groups[path] = groups.get(path, 0) + s.weight
        for path, weight in groups.items():
            numbers[path] = len(out)
            out[numbers[path[:-1]]].append(("/".join(path), weight, len(out)))
            out.append([])
    for s in live:
        out[numbers[s.region, s.rack]].append((f"{s.region}/{s.rack}/{s.shard}", s.weight, -1 - s.shard))
    return out


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard that the key's descent ends in. Shards without weight get nothing."""
    nodes = F.array(
        *[
            F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(i).alias("to")) for n, w, i in own])
            for own in _children(tree)
        ]
    )

    def draw(child: Column) -> Column:
        """An exponential draw with the child's weight as its rate, and where it leads."""
        bits = F.shiftrightunsigned(F.xxhash64(key, child["name"]), 11)
        even = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((-F.log(even) / child["weight"]).alias("draw"), child["to"].alias("to"))

    node = F.lit(0)
    for _ in range(3):
        node = F.array_min(F.transform(F.get(nodes, node), draw))["to"]
    return (-1 - node).cast("int")


def with_shard(df: DataFrame, tree: list[Shard], key_col: str = "doc_id", out: str = "shard") -> DataFrame:
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    return df.withColumn(out, shard_of(key, tree))


def with_slots(df: DataFrame, shard_col: str, order: list[str], buckets: int, out: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without gaps, in buckets by hash of the first column of `order`.

    Each bucket is numbered by itself and starts where those before it end. The table of starts has one
    row per shard and bucket.
    """
    bucket = F.pmod(F.xxhash64(order[0]), F.lit(buckets)).cast("int")
    rows = df.withColumn("__bucket", bucket)
    group = [F.col(shard_col), F.col("__bucket")]
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__n"))
    before = F.expr(
        f"sum(__n) over (partition by `{shard_col}` order by __bucket rows between unbounded preceding and 1 preceding)"
    )
    starts = sizes.select(
        F.col(shard_col).alias("__shard"), F.col("__bucket").alias("__b"), F.coalesce(before, F.lit(0)).alias("__start")
    )
    # Shards times buckets rows: both are parameters, so the table is bounded.
    joined = rows.join(
        F.broadcast(starts), (F.col(shard_col) == F.col("__shard")) & (F.col("__bucket") == F.col("__b"))
    )
    keys = ", ".join(f"`{c}`" for c in order)
    number = F.expr(f"row_number() over (partition by `{shard_col}`, __bucket order by {keys})")
    return joined.withColumn(out, (F.col("__start") + number - 1).cast("long")).drop("__bucket", "__shard", "__b", "__start")


def shard_rows(docs: DataFrame, n: int = BASE, buckets: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Texts are read once and never shuffled.

    `buckets`: hash buckets per shard for numbering; n * buckets tasks can share that work.
    """
    text = F.coalesce("text", F.lit("").cast("string"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_shard(with_shard(rows, topology(n)), topology(n + 1), out="grown_shard")
    return with_slots(placed, "shard", ["doc_id", "size", "text_crc32"], buckets).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
