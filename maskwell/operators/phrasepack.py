"""Phrases by the table: a pack of any size is joined with the texts instead of standing in the plan.

A phrase is found where its characters stand in a text, in either case of A to Z, after the text's start or a blank
(space, tab, line feed, carriage return); what follows is free. A phrase of several words is met by all before its
last word, with the blanks between: at every word of a text the words from there on are one join key for each number
of words that occurs in the pack. The last word may go on in the text and is compared after the join. A phrase of one
word is met by the beginnings of words, one join key for each length that occurs. A bit for each key of the pack, of a
fixed number of bits, travels to the texts, so what meets no phrase is hardly ever moved.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLANK = " \t\n\r"
BLANKS = "[ \\\\t\\\\n\\\\r]"
NAMES_A_PLACE = "phrase IS NOT NULL AND phrase <> '' AND NOT phrase RLIKE '^[ \\\\t\\\\n\\\\r]|[ \\\\t\\\\n\\\\r]$'"
#: Rows of a batch that leaves a Python worker, about.
ROWS = 20_000
#: Bits that tell which join keys a pack may hold. More keys only make them tell less.
BITS = 1 << 22
PLACE = {"seed": pa.string(), "words": pa.int32(), "length": pa.int32(), "at": pa.int32(), "after": pa.string()}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(column: str) -> Column:
    """Lower case of A to Z only, so that places stay."""
    return F.translate(column, UPPER, LOWER)


@dataclass(frozen=True)
class Wanted:
    """What the texts learn of a pack: numbers of words before the last one, lengths of single words, longest last word, bits."""

    words: tuple[int, ...]
    lengths: tuple[int, ...]
    after: int
    bits: bytes


def place_batches(batches: Iterator[pa.RecordBatch], wanted: Wanted, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Places of (key, text) that may hold a phrase: (key, seed, words, length, at, after), at most ``rows`` at a time.

    So a worker never holds all places of a long text, or of the texts that it is handed together.
    """
    lower = str.maketrans(UPPER, LOWER)
    blank = re.compile(f"[^{BLANK}]+")

    def may_be(seed: str) -> bool:
        bit = crc32(seed.encode()) % BITS
        return bool(wanted.bits[bit >> 3] >> (bit & 7) & 1)

    def made(keys: pa.Array, found: list[tuple]) -> pa.RecordBatch:
        of, *columns = zip(*found)
        arrays = [pa.array(column, kind) for column, kind in zip(columns, PLACE.values())]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(of)), *arrays], ["key", *PLACE])

    for batch in batches:
        keys, found = batch.column(0), []
        for i, value in enumerate(batch.column(1)):
            low = value.as_py().translate(lower)
            starts = [m.start() for m in blank.finditer(low)]
            for k, at in enumerate(starts):
                for words in wanted.words:
                    if k + words < len(starts):
                        there = starts[k + words]
                        if may_be(seed := low[at:there]):
                            found.append((i, seed, words, 0, at, low[there : there + wanted.after]))
                if wanted.lengths:
                    word = blank.match(low, at)[0]
                    for length in wanted.lengths:
                        if length <= len(word) and may_be(seed := word[:length]):
                            found.append((i, seed, 0, length, at, ""))
                if len(found) >= rows:
                    yield made(keys, found)
                    found = []
        if found:
            yield made(keys, found)


def text_places(texts: DataFrame, key: str, text: str, wanted: Wanted) -> DataFrame:
    """``place_batches`` over a table."""
    plain = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {dict(plain.dtypes)['key']}, seed string, words int, length int, at int, after string"
    return plain.mapInArrow(lambda batches: place_batches(batches, wanted), schema)


def keyed(pack: DataFrame) -> DataFrame:
    """The pack with ``phrase`` in lower case, its join key ``seed``, ``words``, ``length`` and the ``last`` word to compare.

    Phrases that are empty or begin or end with a blank are left out, as they name no place.
    """
    plain = pack.withColumn("phrase", _low("phrase")).where(NAMES_A_PLACE)
    split = plain.withColumn("last", F.regexp_extract("phrase", f"[^{BLANK}]+$", 0)).withColumn(
        "seed", F.expr("left(phrase, length(phrase) - length(last))")
    )
    words = f"size(filter(split(seed, '{BLANKS}', -1), x -> x <> ''))"
    several = F.col("seed") != ""
    return split.withColumn("words", F.expr(words)).select(
        *pack.columns, F.when(several, F.col("seed")).otherwise(F.col("phrase")).alias("seed"), "words",
        F.when(several, 0).otherwise(F.length("phrase")).alias("length"), F.when(several, F.col("last")).otherwise("").alias("last"),
    )


def wanted_of(seeds: DataFrame) -> Wanted:
    """Numbers and a bitmap of a fixed size, whatever the pack holds."""
    known = seeds.agg(
        F.sort_array(F.collect_set(F.when(F.col("words") > 0, F.col("words")))).alias("words"),
        F.sort_array(F.collect_set(F.when(F.col("words") == 0, F.col("length")))).alias("lengths"),
        F.coalesce(F.max(F.length("last")), F.lit(0)).alias("after"),
    ).first()
    bit = seeds.select((F.crc32("seed") % BITS + 1).alias("bit")).distinct()
    maps = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = bytearray(BITS // 8)
    for row in maps.collect():
        at = (row.part - 1) * len(row.bits)
        bits[at : at + len(row.bits)] = row.bits
    return Wanted(tuple(known.words), tuple(known.lengths), known.after, bytes(bits))


def seeds_of(pack: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Add ``phrase`` in lower case, ``seed``, ``whole`` (the seed is a word, not a beginning) and ``skip``.

    ``skip`` is where the seed begins in the phrase. Of the words that may be seeds the one with the least work is
    taken: how many phrases hold it, times how often ``counts`` (``word``, ``n``) has it in the texts, if given; then
    the longest. Phrases that are empty or begin or end with a blank are left out, as they name no place.
    """
    plain = pack.withColumn("phrase", _low("phrase")).where(
        "phrase IS NOT NULL AND phrase <> '' AND NOT phrase RLIKE '^[ \\\\t\\\\n\\\\r]|[ \\\\t\\\\n\\\\r]$'"
    )
    words = "split(phrase, '[ \\\\t\\\\n\\\\r]', -1)"
    places = (
        f"transform({words}, (x, i) -> named_struct('word', x, 'skip', "
        f"length(array_join(slice({words}, 1, i), ' ')) + if(i > 0, 1, 0)))"
    )
    inner = f"filter(slice({places}, 1, size({words}) - 1), x -> x.word <> '')"
    tried = plain.withColumn("tried", F.expr(inner))
    single = tried.where("size(tried) = 0").select(
        *pack.columns, F.expr(f"element_at({words}, 1)").alias("seed"), F.lit(False).alias("whole"), F.lit(0).alias("skip")
    )
    longer = tried.where("size(tried) > 0").withColumn("number", F.monotonically_increasing_id())
    each = longer.select(*pack.columns, "number", F.explode("tried").alias("t")).select(*pack.columns, "number", "t.word", "t.skip")
    held = each.groupBy(F.col("word").alias("of")).agg(F.count("*").alias("n"))
    if counts is not None:
        told = counts.select(F.col("word").alias("of"), F.col("n").alias("seen"))
        held = held.join(told, "of", "left").withColumn("n", F.col("n") * F.coalesce("seen", F.lit(0)))
    each = each.join(held.select("of", "n"), F.col("word") == F.col("of"))
    best = each.groupBy("number").agg(F.min_by(F.struct(*pack.columns, "word", "skip"), F.struct("n", -F.length("word"), "skip")).alias("b"))
    several = best.select(
        *(F.col("b")[c].alias(c) for c in pack.columns), F.col("b.word").alias("seed"), F.lit(True).alias("whole"), F.col("b.skip").alias("skip")
    )
    return single.unionByName(several)


def phrase_places(
    texts: DataFrame, pack: DataFrame, key: str = "doc_id", text: str = "text", counts: DataFrame | None = None
) -> DataFrame:
    """Every place of every phrase: the key, ``start``, ``end`` and the pack's columns.

    ``pack`` has ``phrase``, which comes back in lower case, and any other columns. Repeated phrases give repeated
    places; a null text has none. The driver learns of the pack what ``Wanted`` holds. ``counts`` is not needed any
    more and changes nothing.
    """
    seeds = keyed(pack)
    met = text_places(texts, key, text, wanted_of(seeds))
    sure = met.join(seeds, ["seed", "words", "length"]).where(F.startswith(F.col("after"), F.col("last")))
    return sure.select(
        F.col("key").alias(key), F.col("at").alias("start"), (F.col("at") + F.length("phrase")).cast("int").alias("end"), *pack.columns
    )


def word_counts(texts: DataFrame, pack: DataFrame, text: str = "text") -> DataFrame:
    """How often the words of the pack's phrases stand in the texts: ``word``, ``n``."""
    wanted = pack.select(F.explode(F.split(_low("phrase"), "[ \\t\\n\\r]")).alias("word")).distinct()
    words = texts.select(F.explode(F.split(_low(text), "[ \\t\\n\\r]+")).alias("word"))
    return words.join(wanted, "word").groupBy("word").agg(F.count("*").alias("n"))


def leftmost(places: DataFrame, key: str = "doc_id") -> DataFrame:
    """Places that a scan from left to right reports: the longest at each start, and none that begins in the last one.

    Only runs of places that touch each other are gathered; equal places are one.
    """
    others = [c for c in places.columns if c not in (key, "start", "end")]
    longest = places.groupBy(key, "start").agg(F.max_by(F.struct("end", *others), "end").alias("p"))
    rows = longest.select(key, "start", "p.*")
    order = Window.partitionBy(key).orderBy("start")
    apart = F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = rows.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order))
    members = F.sort_array(F.collect_list(F.struct("start", "end", *others)))
    kept = F.aggregate(
        "members", F.filter("members", lambda m: F.lit(False)),
        lambda out, m: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] > m["start"]), out).otherwise(F.concat(out, F.array(m))),
    )
    return runs.groupBy(key, "run").agg(members.alias("members")).select(key, F.explode(kept).alias("p")).select(key, "p.*")
