"""Near-duplicate documents by MinHash and an LSH forest.

A document is the set of its word shingles; documents with equal sets form a class. Of each class the
document with the smallest id enters the forest: its signature's `TREES` parts of `DEPTH` minimum hashes are
sorted as so many orders, neighbours with a long common prefix become candidates (see `forest`), and each is
judged by the exact similarity of the full sets. Components of the links are the groups.

At similarity 0.8 two sets share the first four hashes of an order with probability 0.41, in at least one
of 16 orders with 0.9998. A crowded region is cut deeper at first; once the components of those links are known,
the rows outside its largest component are paired with those of the region that they can be similar to, by
sizes, by what each shares with that component's core and by rare shingles in common, so that every two documents
that share four hashes of an order are judged, connected or proven apart. Groups never meet in one task: copies with equal sets are aggregated where they are, and sorted
orders are split by range.

Defined results: null and empty texts and texts without a word have no shingles and are linked with
nothing; a text with fewer words than a shingle is one shingle; a null id stays alone; repeated rows
get the same component and are all kept.
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
from maskwell.llm.shingles import MinHash, WordHashes, linked_components, shingle_set, words_of

TREES, DEPTH = 16, 6
#: Levels that candidates share at least, besides the order's number.
FIRST = 4
#: Rows of a region that are all paired.
SMALL = 8
#: Hashes that must agree for a late pair to be judged: at similarity 0.8 fewer occur once in a million.
AGREE = 58


def features(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set and signature, both null for an empty one."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sign = WordHashes(), MinHash(TREES * DEPTH)
        for batch in batches:
            sizes, digests, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(words_of(text or ""), width, hashes)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(sign(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    schema = f"doc_id {kind}, n_shingles bigint, digest binary, signature binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def orders(signed: DataFrame) -> DataFrame:
    """(key, id) for every sorted order: its number, then its part of the signature."""
    size = 4 * DEPTH
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = signed.select("id", "signature", tree)
    part = F.expr(f"substring(signature, tree * {size} + 1, {size})")
    number = F.unhex(F.lpad(F.hex("tree"), 8, "0"))
    return rows.select(F.concat(number, part).alias("key"), "id")


def shingles_by_id(texts: DataFrame, width: int) -> DataFrame:
    """id, its distinct shingles."""
    kind = dict(texts.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(words_of(text), width, hashes).view(np.int64) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, f"id {kind}, shingles array<bigint>")


def split_by_core(relations: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """For every (top, id, own) of `relations`: n, c and extras.

    The core of a component `top` are the shingles that more than half of its documents hold. `n` is the size
    of the set of `id`, `c` how many of it lie in the core, `extras` the others that some further document
    beside `top` has, too: structs (df, shingle), rarest first. Its length is bounded by that of the document.
    """
    sets = shingles_by_id(texts.join(relations.select("id"), "id", "left_semi"), width)
    held = saved(relations.join(sets, "id").select("top", "id", "own", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    members = relations.groupBy("top").agg(F.count_if(F.col("own") == F.col("top")).alias("members"))
    known = (
        held.groupBy("top", "shingle")
        .agg(F.count("*").alias("df"), F.count_if(F.col("own") == F.col("top")).alias("inside"))
        .filter("df > 1 OR inside > 0")
        .join(members, "top")
        .select("top", "shingle", "df", (2 * F.col("inside") > F.col("members")).alias("core"))
    )
    extra = F.when(~F.col("core") & (F.col("df") > 1), F.struct("df", "shingle"))
    return (
        held.join(known, ["top", "shingle"], "left")
        .groupBy("top", "id", "own", "n")
        .agg(F.count_if("core").alias("c"), F.sort_array(F.collect_list(extra)).alias("extras"))
    )


def late_pairs(rows: DataFrame, found: DataFrame, small: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of `rows` (region, id) that share a crowded region, whose components differ and that may be similar.

    In each region the largest component stands aside: only the rows outside it are paired. Two sets have in
    common at most the smaller of their parts in that component's core, and the extras they share. Where the core
    parts alone could suffice, the rows of the region are paired by sizes. All other pairs must share a number of
    extras that follows from their sizes, so they meet at an extra among the rarest of both (a prefix filter
    with the length that each pair needs).
    """
    crowded = rows.groupBy("region").agg(F.count("*").alias("n")).filter(F.col("n") > small).select("region")
    rows = rows.join(crowded, "region").join(found, "id", "left")
    rows = saved(rows.select("region", "id", F.coalesce("component", "id").alias("own")))
    sizes = rows.select("own", "id").distinct().groupBy("own").agg(F.count("*").alias("n"))
    # Regions that one component fills have nothing to pair.
    largest = (
        rows.select("region", "own").distinct().join(sizes, "own").groupBy("region")
        .agg(F.max(F.struct("n", "own")).alias("top"), F.min("own").alias("low"), F.max("own").alias("high"))
        .filter("low < high")
        .select("region", F.col("top.own").alias("top"))
    )
    placed = saved(rows.join(largest, "region"))
    split = saved(split_by_core(saved(placed.select("top", "id", "own").distinct()), texts, width))

    def ends(rows: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
        own = ["id", "own", "n", "c"] + [c for c in ("x", "rank", "regions") if c in rows.columns]
        one, two = (rows.select(*on, *(F.col(c).alias(f"{c}_{side}") for c in own)) for side in "ab")
        return one.filter(F.col("own_a") != F.col("top")), two

    total = F.col("n_a") + F.col("n_b")
    core = F.least("c_a", "c_b")
    other = (F.col("own_a") != F.col("own_b")) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    # Rows that meet in several regions are paired in the first of them; any one decides.
    every = placed.groupBy("id").agg(F.collect_set("region").alias("regions"))
    one, two = ends(placed.join(split.drop("own", "extras"), ["top", "id"]).join(every, "id"), "region", "top")
    once = F.col("region") == F.array_min(F.array_intersect("regions_a", "regions_b"))
    near = one.join(two.drop("top"), "region").filter(other & (core * (100 + percent) >= total * percent) & once)

    needed = F.ceil(total * percent / (100 + percent)) - core
    at = split.select("top", "id", "own", "n", "c", F.size("extras").alias("x"), F.posexplode("extras").alias("rank", "extra"))
    one, two = ends(at.withColumn("shingle", F.col("extra.shingle")), "top", "shingle")
    in_reach = (F.col("rank_a") <= F.col("x_a") - needed) & (F.col("rank_b") <= F.col("x_b") - needed)
    apart = one.join(two, ["top", "shingle"]).filter(other & (needed > 0) & in_reach)
    return (
        near.select("id_a", "id_b")
        .unionByName(apart.select("id_a", "id_b"))
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
        .distinct()
    )


def across(signed: DataFrame, found: DataFrame, small: int, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The late pairs of regions of `FIRST` levels whose signatures agree in at least `AGREE` of their hashes."""
    size = 4 * (1 + FIRST)
    rows = orders(signed).select(F.expr(f"substring(key, 1, {size})").alias("region"), "id")
    pairs = late_pairs(rows, found, small, texts, width, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u4").reshape(-1, TREES * DEPTH) for c in ("sa", "sb"))
            keep = pa.array((x == y).sum(1) >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    kind = dict(signed.dtypes)["id"]
    one = signed.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    two = signed.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    seen = saved(features(docs, width))
    known = seen.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = saved(
        known.groupBy("digest").agg(
            F.min(F.struct("doc_id", "signature", "n_shingles")).alias("first"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
        )
    )
    signed = classes.select(F.col("first.doc_id").alias("id"), "digest", "first.signature", "first.n_shingles")
    pairs = candidates(orders(signed), 1 + DEPTH, 1 + FIRST, SMALL)
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    linked = linked_components(pairs, texts, width, percent, lambda found: across(signed, found, SMALL, texts, width, percent))
    # Only classes with several documents or with links need a component of their own.
    named = (
        classes.join(linked, F.col("low") == F.col("id"), "left")
        .filter((F.col("low") < F.col("high")) | F.col("component").isNotNull())
        .select(F.col("digest").alias("of"), F.coalesce("component", "low").alias("component"))
    )
    return (
        seen.join(named, F.col("digest") == F.col("of"), "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, without the documents that are not the first of their group."""
    gone = groups(docs, width, percent).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")


def op7_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=2)
