"""Near-duplicate vectors by cross-polytope hashing.

Vectors of one label and length are turned by fast pseudo-random rotations (three rounds of random signs and
a Hadamard transform each) and hashed to the nearest of the 2d signed axes; two such hashes make a bucket, and
each of `TABLES` tables has its own. A vector enters the bucket of its first choices and probes those with the
second choice of either hash. Within a bucket every stored vector is compared with every other and with the
probes. Buckets hold vectors rounded to one byte a component, a fraction of their size; pairs that rounding leaves in
doubt are judged on the whole vectors, so that links are the pairs whose cosine in double precision reaches the limit.

Equal vectors form a class that enters once; its copies count in the numbers of links. A bucket with more
than `BLOCK` rows is cut into blocks and each pair of blocks is a task of its own, so that all of its
pairs are compared, yet none of its tasks grows. Pairs come out only where they are links.

At cosine 0.93 and 64 dimensions a pair shares a bucket or a probe in one table with a probability of
about 0.6, so 16 tables miss less than one in a million; the test measures it against all pairs.

Defined results: vectors that are null, zero, or hold null or non-finite components, and those with a null
label, link with nothing; equal vectors link whatever the rounding; vectors of different lengths never link;
a null id gets no component and is kept; rows that repeat an id are one vector if equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import saved, table
from maskwell.llm.graph import components

TABLES = 16
BLOCK = 2000
#: Rows of a block compared with the others at once.
ROWS = 500
MIN_COSINE = 0.93
SEED = 11


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row; the length is a power of two."""
    n = x.shape[1]
    half = 1
    while half < n:
        x = x.reshape(len(x), n // (2 * half), 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        half *= 2
    return x


def best_axes(x: np.ndarray, rotation: int) -> np.ndarray:
    """The two nearest signed axes of every row, after the rotation of that number."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    random = np.random.default_rng([SEED, rotation, n])
    x = np.pad(x, ((0, 0), (0, n - x.shape[1])))
    for _ in range(3):
        x = hadamard(x * random.choice([-1.0, 1.0], n)) / np.sqrt(n)
    size = np.abs(x)
    two = np.argsort(-size, axis=1, kind="stable")[:, :2]
    return two * 2 + (np.take_along_axis(x, two, 1) < 0)


def short_codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors in steps of one byte, the size of a step, and the length of what rounding took away."""
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    step = np.abs(unit).max(1) / 127
    code = np.rint(unit / step[:, None]).astype(np.int8)
    error = np.sqrt(((unit - code * step[:, None]) ** 2).sum(1))
    return code, step, error


def buckets(classes: DataFrame, with_codes: bool) -> DataFrame:
    """(label, dim, bucket, stored) for every table, one stored row and two probes each; id and code if wanted."""
    kinds = dict(classes.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim").to_pylist(), int)
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = np.array(own.column("vector").to_pylist(), float).reshape(len(own), dim)
                extra = []
                if with_codes:
                    code, step, error = short_codes(x)
                    extra = [own.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(error)]
                for t in range(TABLES):
                    p, q = best_axes(x, 2 * t), best_axes(x, 2 * t + 1)
                    for stored, i, j in ((True, 0, 0), (False, 1, 0), (False, 0, 1)):
                        bucket = (np.int64(t) << 48) | (p[:, i].astype(np.int64) << 24) | q[:, j]
                        yield pa.RecordBatch.from_arrays(
                            [own.column("label"), own.column("dim"), pa.array(bucket), pa.array(np.full(len(own), stored)), *extra],
                            names=names,
                        )

    schema = f"label {kinds['label']}, dim int, bucket bigint, stored boolean"
    if with_codes:
        schema += f", id {kinds['id']}, code binary, step double, error double"
    names = [part.split()[0] for part in schema.split(", ")]
    return classes.select("label", "dim", "id", "vector").mapInArrow(run, schema)


def near_pairs(classes: DataFrame, min_cosine: float) -> DataFrame:
    """(a, b, sure), a < b, of the vectors that share a bucket, are not both probes and may be close.

    Vectors meet as one-byte codes. Rounding moves a cosine by a known amount at most: pairs that stay below the
    limit with it are left out, pairs that stay above it are sure, and the others are judged later.
    """
    kind = dict(classes.dtypes)["id"]
    key = ["label", "dim", "bucket"]
    # Written, so that the planner knows how small the list of large buckets is.
    large = saved(
        buckets(classes, False)
        .groupBy(*key)
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > BLOCK)
        .select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    cut = buckets(classes, True).join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        *key, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "stored", "id", "code", "step", "error"
    )

    def compare(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ends of the pairs of one group, and whether they are sure."""
        ids, own = group.column("id").to_numpy(), group.column("own").to_numpy()
        left = np.nonzero(group.column("stored").to_numpy())[0]
        code = np.frombuffer(b"".join(group.column("code").to_pylist()), np.int8).reshape(len(group), -1)
        v = code * group.column("step").to_numpy()[:, None]
        e = group.column("error").to_numpy()
        a, b, sure = [], [], []
        for at in range(0, len(left), ROWS):
            part = left[at : at + ROWS]
            cosine = v[part] @ v.T
            slack = e[part][:, None] * (1 + e) + e + 1e-9
            r, c = np.nonzero(cosine + slack >= min_cosine)
            over = (cosine - slack >= min_cosine)[r, c]
            r = part[r]
            # A task for two different blocks compares across them only.
            ok = (ids[r] != ids[c]) & ((own[r] != own[c]) | (own.min() == own.max()))
            r, c, over = ids[r[ok]], ids[c[ok]], over[ok]
            a.append(np.minimum(r, c))
            b.append(np.maximum(r, c))
            sure.append(over)
        return np.concatenate(a), np.concatenate(b), np.concatenate(sure)

    def groups(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        """The pairs of all groups that are complete, and the rows of the one that is not."""
        change = np.zeros(len(rows) - 1, bool)
        for name in (*key, "x", "y"):
            values = rows.column(name).to_numpy()
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.nonzero(change)[0] + 1).tolist()]
        if last:
            cuts.append(len(rows))
        stored = np.concatenate([[0], np.cumsum(rows.column("stored").to_numpy())])
        found = [
            compare(rows.slice(start, end - start))
            for start, end in zip(cuts, cuts[1:], strict=False)
            if end - start > 1 and stored[end] > stored[start]
        ]
        rest = rows.slice(cuts[-1])
        if not found:
            return None, rest
        a, b, sure = (np.concatenate(part) for part in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], names=["a", "b", "sure"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            found, rest = groups(pa.concat_tables([rest, new]) if rest is not None else new, False)
            if found is not None:
                yield found
        if rest is not None and len(rest):
            found, _ = groups(rest, True)
            if found is not None:
                yield found

    key_of_task = [*key, "x", "y"]
    dealt = cut.repartition(*key_of_task).sortWithinPartitions(*key_of_task)
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, sure boolean").distinct()


def close_pairs(classes: DataFrame, min_cosine: float) -> DataFrame:
    """(a, b), a < b, of the vectors found whose cosine in double precision reaches the limit."""
    kind = dict(classes.dtypes)["id"]
    pairs = saved(near_pairs(classes, min_cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(), strict=True):
                x, y = np.array(x), np.array(y)
                keep.append(bool((x / np.sqrt(x @ x)) @ (y / np.sqrt(y @ y)) >= min_cosine))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], names=["a", "b"])

    one = classes.select(F.col("id").alias("a"), F.col("vector").alias("va"))
    two = classes.select(F.col("id").alias("b"), F.col("vector").alias("vb"))
    judged = pairs.filter("NOT sure").join(one, "a").join(two, "b").select("a", "b", "va", "vb")
    return pairs.filter("sure").select("a", "b").unionByName(judged.mapInArrow(run, f"a {kind}, b {kind}"))


def vector_links(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding, label)."""
    double = F.col("embedding").cast("array<double>")
    rows = saved(vectors.select("vec_id", F.col("label").alias("label"), double.alias("vector")))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    # Overflow of the squares must not decide, so scale by the largest component first.
    top = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    usable = rows.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0)).filter(finite)
    usable = usable.withColumn("top", top).filter(F.col("top") > 0)
    classes = saved(
        usable.groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("n"))
    )
    scaled = classes.select(
        "label",
        F.size("vector").alias("dim"),
        "id",
        F.transform("vector", lambda x: x / F.array_max(F.transform("vector", lambda y: F.abs(y)))).alias("vector"),
    )
    pairs = saved(close_pairs(scaled, min_cosine))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = classes.select(F.col("id").alias("b"), F.col("n").alias("m"))
    near = both.join(other, "b").groupBy(F.col("a").alias("near_id")).agg(F.sum("m").alias("near"))
    comp = components(pairs).select(F.col("id").alias("comp_id"), "component")
    named = (
        classes.join(near, F.col("id") == F.col("near_id"), "left")
        .join(comp, F.col("id") == F.col("comp_id"), "left")
        .select(
            F.col("label").alias("of_label"),
            F.col("vector").alias("of"),
            (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"),
            F.coalesce("component", "id").alias("component"),
        )
        .filter("links > 0")
    )
    known = F.col("vec_id").isNotNull()
    component = F.when(known, F.coalesce("component", "vec_id"))
    return rows.join(named, (F.col("label") == F.col("of_label")) & (F.col("vector") == F.col("of")), "left").select(
        "vec_id",
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(table(spark, sf_dir, "embeddings"))
