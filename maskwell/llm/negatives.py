"""Hard negatives: exact scores behind summaries of vector segments.

Every vector is stored with the mean and the deviation of each of its segments of four components. For two vectors a
segment of length L adds L times the product of the means to their inner product, plus or minus at most L times the
product of the deviations; the sum over all segments bounds the score from both sides. Sixteen neighbouring components
are tried first, then four, and only pairs whose bounds still reach what is asked of them are scored exactly, in whole
numbers.

An anchor's positives are its best rows of the same label. Each positive asks for the best rows of other labels whose
scores lie between two shares of its own. Both searches cut anchors and rows into blocks of bounded size and let each
block of anchors meet each block of rows in a task of its own, so that neither a label nor the table ends up in one
task; the first keeps to blocks of one label. A task hands on the few best rows of each anchor and no pairs, and what
the best so far ask for tightens as rows go by.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part. Only vectors of
equal length are compared. Every remaining row counts by itself, repeats included, but no row is a partner of a row
with its own id; an anchor that stands twice gives its results twice. Ties go to the smaller id. An anchor without
positives or without rows in reach gives nothing. A score that a long cannot hold fails, as it does in Spark's own
arithmetic. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwell.llm.common import saved, table

#: Components of a vector become whole numbers after this factor.
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
#: Negatives score between these shares of their positive, in percent.
LEAST, MOST = 50, 95
#: The most rows of a block, in expectation, and the anchors that are scored at once.
ANCHORS, ROWS, AT_ONCE = 4096, 2048, 256
#: Components of the finest segment, and how many segments make one of the level before.
SEGMENT, MERGE = 4, 4

NOTHING = np.iinfo(np.int64).min


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every finest segment; missing components count as zeros."""
    parts = max(1, -(-q.shape[1] // SEGMENT))
    whole = np.zeros((len(q), parts * SEGMENT))
    whole[:, : q.shape[1]] = q
    whole = whole.reshape(len(q), parts, SEGMENT)
    return whole.mean(2), whole.std(2)


def levels(mean: np.ndarray, deviation: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(means, deviations, length of a segment), from one level above the stored one to the stored one."""
    missing = -mean.shape[1] % MERGE
    m = np.pad(mean, ((0, 0), (0, missing))).reshape(len(mean), -1, MERGE)
    d = np.pad(deviation, ((0, 0), (0, missing))).reshape(len(mean), -1, MERGE)
    coarse = (m.mean(2), np.sqrt((d * d).mean(2) + m.var(2)), SEGMENT * MERGE)
    return [coarse, (mean, deviation, SEGMENT)]


class Side:
    """The vectors of one block, which is not empty, with their summaries."""

    def __init__(self, block: pa.Table):
        def matrix(name: str, kind: type) -> np.ndarray:
            flat = block.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            return flat.astype(kind, copy=False).reshape(len(block), len(flat) // len(block))

        self.q = matrix("q", np.int64)
        self.levels = levels(matrix("mean", float), matrix("deviation", float))
        # As an array of floats; q itself may hold the least long, which has no positive counterpart.
        self.top = float(np.abs(self.q.astype(float)).max(initial=0))
        self.norm = float(np.sqrt((self.q.astype(float) ** 2).sum(1)).max(initial=0))

    def exact_type(self, other: Side, rows: int) -> type:
        """The plainest type in which scores of the two sides, times `rows`, are exact."""
        most = self.top * other.top * max(1, self.q.shape[1])
        if most * rows >= 2**62:
            return object
        return float if most < 2**53 else np.int64


def survivors(a: Side, b: Side, i: np.ndarray, j: np.ndarray, alive: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) in `alive` may score from `least` to `most`, two numbers for every i."""
    slack = 1e-9 * (1 + a.norm * b.norm)
    for (am, ad, length), (bm, bd, _) in zip(a.levels, b.levels, strict=True):
        r, c = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
        if not len(r):
            break
        middle = length * (am[i[r]] @ bm[j[c]].T)
        spread = length * (ad[i[r]] @ bd[j[c]].T) + slack
        alive[np.ix_(r, c)] &= (middle + spread >= least[r, None]) & (middle - spread <= most[r, None])
    return alive


def scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray, kind: type) -> np.ndarray:
    out = a.q[i].astype(kind) @ b.q[j].astype(kind).T
    return out.astype(np.int64) if kind is float else out


def keep_best(best: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The largest keys of each row, as many as `best` has."""
    n = best.shape[-1]
    both = np.concatenate([best, keys], axis=-1)
    return np.sort(both, axis=-1)[..., -n:] if both.dtype == object else np.partition(both, both.shape[-1] - n, axis=-1)[..., -n:]


def by_id(rows: pa.Table, name: str) -> pa.Table:
    return rows.take(pc.sort_indices(rows, [(name, "ascending")]))


def best_in_block(
    anchors: pa.Table, rows: pa.Table, least: np.ndarray, most: np.ndarray, own_label: bool, n: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, wish, score, row), the n best rows of `rows` for every wish of every anchor.

    Wishes are columns of `least` and `most`, the scores that are asked for. `rows` come in the order of their ids, so
    a key of score and place puts equal scores in that order.
    """
    a, b = Side(anchors), Side(rows)
    size, wishes = len(rows), least.shape[1]
    kind = a.exact_type(b, size)
    a_id, b_id = (t.column("id").to_numpy(zero_copy_only=False) for t in (anchors, rows))
    a_label, b_label = (t.column("label").to_numpy(zero_copy_only=False) for t in (anchors, rows))
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(anchors), AT_ONCE):
        i = np.arange(at, min(at + AT_ONCE, len(anchors)))
        best = np.full((len(i), wishes, n), NOTHING, object if kind is object else np.int64)
        for start in range(0, size, AT_ONCE * 2):
            j = np.arange(start, min(start + AT_ONCE * 2, size))
            alive = a_id[i][:, None] != b_id[j][None, :]
            if not own_label:
                alive &= a_label[i][:, None] != b_label[j][None, :]
            # The worst of the best rows so far raises what is asked for once all places are taken.
            worst = best.min(2)
            need = np.maximum(least[i], np.where(worst == NOTHING, NOTHING, worst // size))
            lowest, highest = need.min(1).astype(float), most[i].max(1).astype(float)
            alive = survivors(a, b, i, j, alive, lowest, highest)
            r, c = np.nonzero(alive.any(1))[0], np.nonzero(alive.any(0))[0]
            if not len(r):
                continue
            score = scores(a, b, i[r], j[c], kind)
            key, open_ = score * size + (size - 1 - j[c])[None, :], alive[np.ix_(r, c)]
            for k in range(wishes):
                fits = open_ & (score >= need[r, k, None]) & (score <= most[i[r], k, None])
                best[r, k] = keep_best(best[r, k], np.where(fits, key, NOTHING))
        x, k, p = np.nonzero(best != NOTHING)
        keys = best[x, k, p]
        found.append((i[x], k, keys // size, size - 1 - keys % size))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def meet(anchors: DataFrame, rows: DataFrame, by: list[str]):
    """Anchors and rows with equal `by`, cogrouped so that every block of one side meets every block of the other."""
    # Written, so that the planner knows how small the list is.
    sizes = saved(
        anchors.groupBy(*by)
        .agg(F.count("*").alias("na"))
        .join(rows.groupBy(*by).agg(F.count("*").alias("nr")), by)
        .select(*by, F.ceil(F.col("na") / ANCHORS).cast("int").alias("xs"), F.ceil(F.col("nr") / ROWS).cast("int").alias("ys"))
    )

    def dealt(side: DataFrame, own: str, other: str, block: str, copies: str) -> DataFrame:
        # Columns of their own, as both sides may come from one table.
        side = side.select(*[F.col(c).alias(c) for c in side.columns])
        side = side.join(sizes, by).withColumn(block, F.pmod(F.xxhash64("number"), F.col(own)).cast("int"))
        return side.withColumn(copies, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("xs", "ys")

    key = [*by, "x", "y"]
    return dealt(anchors, "xs", "ys", "x", "y").groupBy(*key).cogroup(dealt(rows, "ys", "xs", "y", "x").groupBy(*key))


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    """(number, id, label, dim, q, mean, deviation) of the rows that take part, written."""
    double = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").alias("id"), label.alias("label"), double.alias("v"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    whole = F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("long"))
    rows = rows.select(F.monotonically_increasing_id().alias("number"), "id", "label", F.size("v").alias("dim"), whole.alias("q"))
    kinds = dict(rows.dtypes)
    schema = f"number bigint, id {kinds['id']}, label {kinds['label']}, dim int, q array<bigint>, mean array<double>, deviation array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                q = own.column("q").flatten().to_numpy().reshape(len(own), dim)
                mean, deviation = (
                    pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), part.shape[1]).cast(pa.list_(pa.float64()))
                    for part in summaries(q)
                )
                yield pa.RecordBatch.from_arrays([*own.columns, mean, deviation], names=[*own.schema.names, "mean", "deviation"])

    return saved(rows.mapInArrow(run, schema))


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from `vectors` (vec_id, embedding).

    `is_anchor` is a predicate on `id`; `label` is an expression over the columns of `vectors`.
    """
    rows = usable(vectors, label)
    kind = dict(rows.dtypes)["id"]
    wanted = ["number", "id", "label", "dim", "q", "mean", "deviation"]
    anchors = rows.filter(is_anchor).select(*wanted)

    def first(left: pa.Table, right: pa.Table) -> pa.Table:
        right = by_id(right, "id")
        low, high = (np.full((len(left), 1), x) for x in (NOTHING + 1, np.iinfo(np.int64).max))
        i, _, score, j = best_in_block(left, right, low, high, True, positives)
        return pa.table(
            {"number": left.column("number").take(pa.array(i)), "partner": right.column("id").take(pa.array(j.astype(np.int64))), "score": pa.array(score, pa.int64())}
        )

    near = meet(anchors, rows.select(*wanted), ["label", "dim"]).applyInArrow(first, f"number bigint, partner {kind}, score bigint")
    order = Window.partitionBy("number").orderBy(F.desc("score"), "partner")
    near = near.withColumn("wish", F.row_number().over(order)).filter(F.col("wish") <= positives)
    near = saved(near.select("number", "wish", F.col("partner").alias("positive_id"), F.col("score").alias("positive_score")))

    # At most `positives` scores for each anchor.
    asked = near.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("wish", "positive_score"))).alias("asked"))
    asked = asked.select("number", F.col("asked.wish").alias("wishes"), F.col("asked.positive_score").alias("asked"))
    asking = saved(anchors.join(asked, "number").select(*wanted, "wishes", "asked"))

    def second(left: pa.Table, right: pa.Table) -> pa.Table:
        right = by_id(right, "id")
        # Python's whole numbers: a share of a score is exact whatever its size.
        low = np.full((len(left), positives), np.iinfo(np.int64).max)
        high = np.full((len(left), positives), NOTHING)
        for row, values in enumerate(left.column("asked").to_pylist()):
            for k, p in enumerate(values):
                low[row, k], high[row, k] = -((-least * p) // 100), most * p // 100
        i, k, score, j = best_in_block(left, right, low, high, False, negatives)
        return pa.table(
            {
                "number": left.column("number").take(pa.array(i)),
                "wish": pa.array(k + 1, pa.int32()),
                "negative_id": right.column("id").take(pa.array(j.astype(np.int64))),
                "negative_score": pa.array(score, pa.int64()),
            }
        )

    far = meet(asking, rows.select(*wanted), ["dim"]).applyInArrow(
        second, f"number bigint, wish int, negative_id {kind}, negative_score bigint"
    )
    order = Window.partitionBy("number", "wish").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    named = near.join(anchors.select("number", F.col("id").alias("anchor_id")), "number")
    return far.join(named, ["number", "wish"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 50; every seventh label is moved on by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


ORACLE = f"""
WITH rows AS (
  SELECT row_number() OVER () AS number, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pairs AS (
  SELECT a.number, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY number ORDER BY score DESC, other) <= {POSITIVES}
)
SELECT p.anchor_id, p.other AS positive_id,
       (row_number() OVER (PARTITION BY p.number, p.other ORDER BY n.score DESC, n.other))::INTEGER AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.number = p.number AND NOT n.same
  AND {LEAST} * p.score <= 100 * n.score AND 100 * n.score <= {MOST} * p.score
QUALIFY rank <= {NEGATIVES}
"""
