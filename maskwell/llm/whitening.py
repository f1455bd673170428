"""Whitening of vectors by a block Jacobi-Davidson method.

The covariance matrix is never formed. Its product with a few columns at once is one pass over the rows: every task
centres its vectors, multiplies them with the columns and their transpose with the result, and hands on one small
matrix; Spark adds these up. Whole numbers are centred as n * x - S before anything is rounded, so large offsets cost
no digits.

The driver keeps a search space of as many rows as a vector has components and a few dozen columns. Each round takes the
best approximations from it (Rayleigh-Ritz), locks those whose residuals have reached double precision, and corrects
all others together: the projected correction equations are solved by MINRES, whose steps share one product for all
columns. The corrections widen the search space, and a full one is cut back to its best columns.

Defined results: rows whose vector is null, or holds null or non-finite entries, are dropped; so are rows whose vector
has another length than most (the longer on a tie), and empty ones. Repeated rows and null ids count and are returned.
A direction without variance cannot be scaled: its `whitened` is null and `explained` 0. `deviation` is null where a
long cannot hold it. An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.common import saved, table

COMPONENTS = 32
#: A component c becomes the whole number floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Columns beyond the wanted ones, and how often those fit into the search space when it is full and after a restart.
GUARD, SPACE, RESTART = 8, 6, 2
#: Steps of the inner solver, and the fall of all its residuals that ends it early.
INNER_STEPS, INNER_FALL = 4, 1e-3
#: Rounds after which the method gives up, far more than it needs.
ROUNDS = 300
SEED = 11

Product = Callable[[np.ndarray], np.ndarray]


def new_columns(wanted: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what `wanted` adds to the orthonormal columns of `known`."""
    basis = np.hstack(known) if known else np.zeros((len(wanted), 0))
    size = np.linalg.norm(wanted, axis=0)
    out = wanted[:, size > 0] / size[size > 0]
    for _ in range(2):
        out = out - basis @ (basis.T @ out)
    u, s, _ = np.linalg.svd(out, full_matrices=False)
    out = u[:, s > 1e-10][:, : len(wanted) - basis.shape[1]]
    # The parts that were small had lost digits.
    out = out - basis @ (basis.T @ out)
    return np.linalg.qr(out)[0]


def minres(
    product: Product, shifts: np.ndarray, basis: np.ndarray, right: np.ndarray, steps: int = INNER_STEPS
) -> np.ndarray:
    """Approximate t with P (A - shift) P t = right, a column each, where P takes `basis` away."""

    def project(x: np.ndarray) -> np.ndarray:
        return x - basis @ (basis.T @ x)

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(x == 0, 1.0, x)

    right = project(right)
    beta = np.linalg.norm(right, axis=0)
    start = beta.copy()
    old, v = np.zeros_like(right), right / safe(beta)
    x, w_old, w = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    rest, cos_old, sin_old, cos, sin = start.copy(), np.ones_like(beta), np.zeros_like(beta), np.ones_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if (np.abs(rest) <= INNER_FALL * start).all():
            break
        z = project(product(v) - v * shifts) - old * beta
        alpha = (v * z).sum(0)
        z = project(z - v * alpha)
        after = np.linalg.norm(z, axis=0)
        # Two old rotations, then the one that removes what stands below the diagonal.
        upper, middle, diagonal = sin_old * beta, cos_old * beta, alpha
        middle, diagonal = cos * middle + sin * diagonal, cos * diagonal - sin * cos_old * beta
        length = np.hypot(diagonal, after)
        cos_old, sin_old, cos, sin = cos, sin, diagonal / safe(length), after / safe(length)
        step = (v - w_old * upper - w * middle) / safe(length)
        step[:, length == 0] = 0
        x = x + step * (cos * rest)
        rest = -sin * rest
        w_old, w, old, v, beta = w, step, v, z / safe(after), after
    return project(x)


def jacobi_davidson(product: Product, size: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `wanted` eigenvalues, falling, and their vectors, of a symmetric matrix known by its products."""
    random = np.random.default_rng(SEED)
    eps = np.finfo(float).eps
    basis = np.linalg.qr(random.standard_normal((size, min(size, wanted + GUARD))))[0]
    image = product(basis)
    locked, locked_image = np.zeros((size, 0)), np.zeros((size, 0))
    best, stalled = np.inf, 0
    for _ in range(ROUNDS):
        h = basis.T @ image
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        need = wanted - locked.shape[1]
        rest = image[:, :need] - basis[:, :need] * values[:need]
        rest = rest - locked @ (locked.T @ rest)
        length = np.linalg.norm(rest, axis=0)
        limit = size * eps * max(values[0], np.abs(np.einsum("ij,ij->j", locked, locked_image)).max(initial=0))
        full = locked.shape[1] + basis.shape[1] == size
        stalled = 0 if length.max() < best / 2 else stalled + 1
        best = min(best, length.max())
        # In the whole space nothing can be added; residuals that no longer fall are down to the products' rounding.
        ended = full or (stalled >= 8 and length.max() <= 100 * limit)
        ready = need if ended else int(np.argmax(np.append(length > limit, True)))
        if ready:
            locked, locked_image = np.hstack([locked, basis[:, :ready]]), np.hstack([locked_image, image[:, :ready]])
            basis, image, best, stalled = basis[:, ready:], image[:, ready:], np.inf, 0
            values, rest, length = values[ready:], rest[:, ready:], length[ready:]
        need -= ready
        if not need:
            break
        open_ = np.nonzero(length > limit)[0]
        # What the search space holds already need not be solved for, which also keeps close values out of the equation.
        more = minres(product, values[open_], np.hstack([locked, basis]), -rest[:, open_])
        more = new_columns(more, locked, basis)
        if not more.shape[1]:
            more = new_columns(random.standard_normal((size, 1)), locked, basis)
        if basis.shape[1] + more.shape[1] > SPACE * wanted + GUARD:
            basis, image = basis[:, : RESTART * wanted + GUARD], image[:, : RESTART * wanted + GUARD]
        basis, image = np.hstack([basis, more]), np.hstack([image, product(more)])
    else:
        raise ArithmeticError(f"no double precision after {ROUNDS} rounds")
    # What was locked at different times is put into one order by a last Rayleigh-Ritz step with a fresh product.
    locked = np.linalg.qr(locked)[0]
    h = locked.T @ product(locked)
    values, turn = np.linalg.eigh((h + h.T) / 2)
    return values[::-1], (locked @ turn)[:, ::-1]


@dataclass(frozen=True)
class Fit:
    """Count, exact sums and spread of the fitted rows: as much as one vector."""

    n: int
    sums: tuple[int, ...]
    #: The largest size of n * x - S, to see whether longs hold it.
    most: int

    def centred(self, column: pa.Array) -> np.ndarray:
        """n * x - S of every row, exact."""
        kind = np.int64 if self.most < 2**62 else object
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(self.sums))
        return self.n * x.astype(kind) - np.array(self.sums, kind)

    def vectors(self, column: pa.Array) -> np.ndarray:
        """x - S / n of every row, rounded once."""
        return (self.centred(column) / self.n).astype(float)


def added_up(rows: DataFrame, size: int, partial: Callable[[Iterator[pa.Array]], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of the array of `size` numbers that `partial` makes of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = partial(batch.column("x") for batch in batches if batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], names=["cell", "value"])

    parts = rows.select("x").mapInArrow(run, "cell int, value double")
    total = np.zeros(size)
    # As many cells as a vector has components times the columns, whatever the number of rows.
    for cell, value in parts.groupBy("cell").agg(F.sum("value")).collect():
        total[cell] = value
    return total


def product_of(rows: DataFrame, fit: Fit) -> Product:
    """The covariance matrix as a function of columns, one pass over the rows each."""
    d = len(fit.sums)

    def product(columns: np.ndarray) -> np.ndarray:
        def partial(parts: Iterator[pa.Array]) -> np.ndarray:
            out = np.zeros(columns.shape)
            for part in parts:
                c = fit.vectors(part)
                out += c.T @ (c @ columns)
            return out.ravel()

        return added_up(rows, columns.size, partial).reshape(d, -1) / fit.n

    return product


def total_variance(rows: DataFrame, fit: Fit) -> float:
    return added_up(rows, 1, lambda parts: np.array([sum(float((fit.vectors(p) ** 2).sum()) for p in parts)]))[0] / fit.n


def identity_error(rows: DataFrame, fit: Fit, turn: np.ndarray) -> float:
    """The largest entry of the covariance of the whitened rows, minus one on its diagonal."""
    k = turn.shape[1]

    def partial(parts: Iterator[pa.Array]) -> np.ndarray:
        out = np.zeros((k + 1, k))
        for part in parts:
            y = fit.vectors(part) @ turn
            out[:k] += y.T @ y
            out[k] += y.sum(0)
        return out.ravel()

    both = added_up(rows, (k + 1) * k, partial).reshape(k + 1, k) / fit.n
    return float(np.abs(both[:k] - np.outer(both[k], both[k]) - np.eye(k)).max(initial=0))


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part, written."""
    double = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", double.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    x = F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c).cast("long") + F.lit(OFFSET).cast("long"))
    rows = saved(rows.select("vec_id", x.alias("x")))
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (lengths.d if lengths else 0))


def fitted(rows: DataFrame) -> Fit | None:
    """Exact count, sums and range; None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, [], [], []
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                low.append(int(x.min()))
                high.append(int(x.max()))
                # A batch of numbers below 2^40 cannot overflow a long.
                wide = x if max(-low[-1], high[-1]) < 2**40 else x.astype(object)
                own = [int(s) for s in wide.sum(0)]
                n, sums = n + len(x), [a + b for a, b in zip(own, sums or [0] * len(own), strict=True)]
        if n:
            size = len(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([str(s) for s in sums]), pa.array([n] * size), pa.array([min(low)] * size), pa.array([max(high)] * size)],
                names=["at", "s", "n", "low", "high"],
            )

    parts = rows.select("x").mapInArrow(run, "at int, s string, n bigint, low bigint, high bigint")
    cells = parts.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")), F.sum("n"), F.min("low"), F.max("high")).collect()
    if not cells:
        return None
    cells.sort()
    n, low, high = cells[0][2], min(c[3] for c in cells), max(c[4] for c in cells)
    return Fit(n, tuple(int(c[1]) for c in cells), n * (high - low))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error from `vectors` (vec_id, embedding)."""
    rows = whole_vectors(vectors)
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = fitted(rows)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d = len(fit.sums)
    k = min(components, d)
    total = total_variance(rows, fit)
    values, turn = jacobi_davidson(product_of(rows, fit), d, k) if total > 0 else (np.zeros(k), np.eye(d)[:, :k])
    # Below this a value is the rounding of zero.
    with_variance = values > d * np.finfo(float).eps * max(values[0], 0)
    scaled = turn / np.sqrt(np.where(with_variance, values, 1))
    error = identity_error(rows, fit, scaled[:, with_variance])
    explained = np.where(with_variance, values, 0) / (total or 1)
    names = [part.strip().split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            exact = fit.centred(batch.column("x"))
            if exact.dtype == object or d * fit.most**2 >= 2**63:
                deviation = [v if (v := sum(int(x) ** 2 for x in row)) < 2**63 else None for row in exact]
            else:
                deviation = (exact * exact).sum(1)
            y = (exact / fit.n).astype(float) @ scaled
            size = len(y)
            each = pa.array(np.repeat(np.arange(size), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * k, fit.n)),
                    pa.array(deviation, pa.int64()).take(each),
                    pa.array(y.ravel(), mask=np.tile(~with_variance, size)),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * k, error)),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
