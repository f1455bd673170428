"""Language by prediction by partial matching over bytes.

Each language has a context tree: for every context of up to three bytes, how often each byte followed.
The code length of a byte is -log2 n/(N+d) in its longest context that has seen anything (N followers, d
different ones); a byte that never followed there costs the escape, -log2 d/(N+d), and is coded in the
context shortened by one, at last at eight bits. A text's language is the one whose tree codes it
shortest; the statistics are frozen, so the length of a byte depends on it and its context alone. All
lengths are therefore worked out once, into a table with a row per context that any tree holds, and a text
is scored by looking its bytes up.

The trees learn from a bounded sample of labelled rows, `per_language` of each of at most `MAX_LANGUAGES` languages,
whole texts, chosen by a hash of the id. The table keeps the `max_contexts` contexts of three bytes that occur most and
126 byte values (others share one); with fewer, contexts fall back to two bytes.

Defined results: `und` with score 0 for a null text, one without a letter, and when nothing was learned;
ties go to the first language by name; a NUL byte and the start of a text are the same context and cost
nothing; the score is the posterior probability under equal priors; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import table

#: Bound of the training sample, in documents of one language.
PER_LANGUAGE = 400
#: Languages that are learned, the most frequent ones.
MAX_LANGUAGES = 200
MAX_CONTEXTS = 30_000
MAX_BYTES = 126
ORDER = 3
#: Positions scored at a time.
STEP = 1 << 18


def id_remainder(column: Column, by: int) -> Column:
    return F.coalesce(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % by, F.lit(0))


@dataclass
class Trees:
    languages: list[str]
    classes: np.ndarray  # byte -> class; 0 is the start
    rows: np.ndarray  # three classes -> row of the table
    costs: np.ndarray  # row * width + class -> bits per language

    @property
    def width(self) -> int:
        return int(self.classes.max()) + 1


def padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each text behind three NULs, and where each begins and ends."""
    joined = pc.binary_join_element_wise(pa.scalar("\0" * ORDER), texts.cast(pa.large_string()).cast(pa.string()), "")
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[: len(joined) + 1].astype(np.int64)
    data = joined.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def code_lengths(trees: Trees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits per text and language."""
    total = np.zeros((len(offsets) - 1, len(trees.languages)))
    width = trees.width
    for start in range(ORDER, len(data), STEP):
        end = min(len(data), start + STEP)
        c = trees.classes[data[start - ORDER : end]]
        context = (c[:-3] * width + c[1:-2]) * width + c[2:-1]
        bits = trees.costs[trees.rows[context] * width + c[3:]]
        first = int(np.searchsorted(offsets, start, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        cuts = np.concatenate([[start], offsets[first + 1 : last]]) - start
        total[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
    return total


def window_counts(labelled: DataFrame) -> DataFrame:
    """(lang, window, n): how often each four bytes occur in the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = batch.column(1)
            for name in sorted(set(names)):
                own = texts.filter(pa.array([n == name for n in names]))
                data, _ = padded(own)
                w = data.astype(np.uint32)
                windows = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
                windows = windows[(windows & 255) != 0]
                seen, n = np.unique(windows, return_counts=True)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name] * len(seen), pa.string()), "window": seen.astype(np.int64), "n": n.astype(np.int64)}
                )

    return (
        labelled.select("lang", "text")
        .mapInArrow(run, "lang string, window bigint, n bigint")
        .groupBy("lang", "window")
        .agg(F.sum("n").alias("n"))
    )


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """At most `per_language` labelled documents of each language, one for each value of a hash."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder(F.col("doc_id"), 4) != 2))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(per_language))
    chosen = (
        labelled.groupBy("lang", slot.alias("slot"))
        .agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(1)).alias("h"), F.col("doc_id").alias("id"))).alias("pick"))
        .select(F.col("pick.id").alias("picked"), F.col("lang").alias("picked_lang"))
    )
    often = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES)
    chosen = chosen.join(F.broadcast(often.select(F.col("lang").alias("picked_lang"))), "picked_lang")
    # At most `per_language` times MAX_LANGUAGES rows, so texts need no shuffle to meet them.
    return labelled.join(F.broadcast(chosen), (F.col("doc_id") == F.col("picked")) & (F.col("lang") == F.col("picked_lang"))).select(
        "lang", "text"
    )


def grow(counts: list[tuple[str, np.ndarray, np.ndarray]], max_contexts: int = MAX_CONTEXTS) -> Trees | None:
    """The table of code lengths from (language, windows, counts)."""
    if not counts:
        return None
    occurs = np.zeros(256)
    for _, windows, n in counts:
        np.add.at(occurs, windows & 255, n)
    occurs[0] = 0
    common = np.argsort(-occurs, kind="stable")[:MAX_BYTES]
    common = np.sort(common[occurs[common] > 0])
    classes = np.full(256, len(common) + 1, np.int64)
    classes[common] = np.arange(1, len(common) + 1)
    classes[0] = 0
    a = len(common) + 2
    mapped = []
    for _, windows, n in counts:
        w = [classes[(windows >> s) & 255] for s in (24, 16, 8, 0)]
        mapped.append((((w[0] * a + w[1]) * a + w[2]) * a + w[3], n.astype(np.float64)))

    def level(cells: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths in contexts with these follower counts, given those in the shorter contexts."""
        n, d = cells.sum(1, keepdims=True), (cells > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = -np.log2(cells / (n + d))
            escaped = -np.log2(d / (n + d)) + shorter
        return np.where(n == 0, shorter, np.where(cells > 0, seen, escaped))

    joint = np.concatenate([w // a for w, _ in mapped])
    weight = np.concatenate([n for _, n in mapped])
    contexts, inverse = np.unique(joint, return_inverse=True)
    often = np.bincount(inverse, weight)
    kept = np.sort(contexts[np.argsort(-often, kind="stable")[:max_contexts]])
    rows = np.tile(np.arange(a * a) + len(kept), a)
    rows[kept] = np.arange(len(kept))
    costs = np.zeros(((len(kept) + a * a) * a, len(counts)), np.float32)
    for i, (w, n) in enumerate(mapped):
        follow = np.zeros((a, a, a))
        np.add.at(follow.reshape(-1), w % (a**3), n)
        none = level(follow.sum((0, 1))[None, :], np.full((1, a), 8.0))
        one = level(follow.sum(0), none)
        two = level(follow.reshape(a * a, a), np.tile(one, (a, 1)))
        at = np.searchsorted(kept, w // a)
        own = (at < len(kept)) & (kept[np.minimum(at, len(kept) - 1)] == w // a)
        cells = np.zeros((len(kept), a))
        np.add.at(cells, (at[own], w[own] % a), n[own])
        three = level(cells, two[kept % (a * a)])
        both = np.concatenate([three, two])
        both[:, 0] = 0
        costs[:, i] = both.reshape(-1)
    return Trees([name for name, _, _ in counts], classes, rows.astype(np.int64), costs)


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, max_contexts: int = MAX_CONTEXTS) -> Trees | None:
    """Trees from the labelled rows of `docs` (doc_id, text, lang) that are not held out.

    What reaches the driver are counts of four-byte windows of the bounded sample.
    """
    counts = window_counts(training_sample(docs, per_language)).toPandas()
    parts = [
        (name, own["window"].to_numpy(), own["n"].to_numpy())
        for name, own in sorted(counts.groupby("lang"), key=lambda x: x[0])
    ]
    return grow(parts, max_contexts)


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, code_bits for every row of `docs`."""
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            letters = np.array(batch.column(2).to_pylist(), bool)
            n = len(letters)
            if model is None:
                best, score, bits = np.zeros(n, int), np.zeros(n), np.zeros(n)
                letters[:] = False
            else:
                total = code_lengths(model, *padded(batch.column(1)))
                best = total.argmin(1)
                bits = total.min(1)
                score = 1 / np.exp2(np.maximum(bits[:, None] - total, -1000)).sum(1)
            names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(bits)],
                names=["doc_id", "lang_pred", "score", "code_bits"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    out = rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, code_bits double")
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "code_bits"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
