"""Whitening of embeddings: leading components of the covariance by Jacobi-Davidson.

The covariance is never formed. What the solver needs of it are its products with a few vectors at a
time; each is one pass over the table, ``sum (x - m) ((x - m) . u) / n`` summed up in tasks and then by
Spark. The solver holds a few dozen vectors of the embeddings' dimension on the driver:

* Rayleigh-Ritz in the search space gives approximate pairs (value, vector) and their residuals;
* for all open pairs together the projected correction equation
  ``(I - QQ') (V - value I) (I - QQ') t = -residual`` is solved roughly by MINRES, whose products
  are made in step, so that one pass serves them all; ``Q`` holds the locked vectors and the pair's own;
* corrections widen the search space, which starts anew from its best vectors when it is full;
* pairs whose residual has reached double precision are locked, and the search goes on beside them.

When enough pairs are locked the search goes on until the best open one is known to be no larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.shared import stored

#: Components are counted in such parts of 1. The constant that the operator's definition adds to all of
#: them takes no part: neither a covariance nor a difference from the mean has it.
SCALE = 1024
COMPONENTS = 8
#: Numbers in a stored block of vectors, at most (2 MB).
BLOCK = 1 << 18
#: Steps of MINRES for a correction.
INNER = 4
#: The search space starts anew beyond so many times the number of components.
SPACE = 8
#: A residual counts as zero below so many units in the last place of the largest eigenvalue.
ULPS = 64
#: Rounds after which a search gives up with an error.
ROUNDS = 200

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """Mean and leading components of a table of whole-number vectors."""

    n: int
    #: Exact sums of the vectors' components.
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    #: Unit eigenvectors as columns.
    vectors: np.ndarray
    passes: int = 0

    @property
    def middle(self) -> np.ndarray:
        """The mean rounded to whole numbers."""
        return np.array([round_div(s, self.n) for s in self.sums], "i8")

    @property
    def rest(self) -> np.ndarray:
        """What the mean is above ``middle``, to full precision."""
        return np.array(
            [(s - self.n * round_div(s, self.n)) / self.n for s in self.sums]
        )


def round_div(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def whole(vector: Column) -> Column:
    """``floor(1024 * c)`` for each component; null if the vector, a component, or its number is
    missing or not finite."""
    known = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when(known, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def filled(column: pa.Array, dim: int) -> np.ndarray:
    """A matrix of lists of whole numbers; shorter lists are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    matrix = np.zeros((len(sizes), dim), "i8")
    matrix[np.arange(dim) < sizes[:, None]] = column.flatten().to_numpy()
    return matrix


def blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (``x``: lists of whole numbers) as matrices of at most ``BLOCK`` numbers, or one row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                dim = max(1, int(np.diff(batch["x"].offsets.to_numpy()).max()))
                part = batch.slice(at, max(1, BLOCK // dim))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([filled(part["x"], dim).tobytes()], pa.binary())],
                    names=["dim", "data"],
                )

    return rows.select("x").mapInArrow(pack, "dim int, data binary")


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield np.frombuffer(batch["data"][i].as_py(), "<i8").reshape(-1, batch["dim"][i].as_py())


def moments(table: DataFrame) -> tuple[int, list[int], list[int]]:
    """Number of vectors and, exactly, the sums of their components and of their squares."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.empty(0, object), np.empty(0, object)
        for x in matrices(batches):
            if x.shape[1] > len(sums):
                more = np.zeros(x.shape[1] - len(sums), object)
                sums, squares = np.r_[sums, more], np.r_[squares, more]
            n += len(x)
            own = x if np.abs(x).max() < 1 << 22 else x.astype(object)
            sums[: x.shape[1]] += own.sum(0).astype(object)
            squares[: x.shape[1]] += (own * own).sum(0).astype(object)
        place = pa.array(range(-1, len(sums)), pa.int32())
        totals = [pa.array([str(v) for v in (n, *z)]) for z in (sums, squares)]
        yield pa.RecordBatch.from_arrays([place, *totals], names=["i", "s", "q"])

    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("s", "q")]
    totals = table.mapInArrow(add, "i int, s string, q string").groupBy("i").agg(*exact)
    rows = sorted(totals.collect())  # a row a component
    if not rows:
        return 0, [], []
    return int(rows[0]["s"]), [int(r["s"]) for r in rows[1:]], [int(r["q"]) for r in rows[1:]]


def distributed(table: DataFrame, n: int, middle: np.ndarray, rest: np.ndarray) -> Product:
    """Products of the covariance of the stored vectors with the columns of a matrix; one Spark job."""
    dim = len(middle)

    def product(u: np.ndarray) -> np.ndarray:
        width = u.shape[1]

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((dim, width))
            for x in matrices(batches):
                centred = np.zeros((len(x), dim))
                centred[:, : x.shape[1]] = x
                centred -= middle  # whole numbers: exact
                centred -= rest
                total += centred.T @ (centred @ u)
            columns = [pa.array(np.arange(dim), pa.int64()), *(pa.array(c) for c in np.ascontiguousarray(total.T))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

        names = ["i", *(f"v{j}" for j in range(width))]
        schema = ", ".join(["i long", *(f"{c} double" for c in names[1:])])
        sums = table.mapInArrow(add, schema).groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]])
        rows = sums.toPandas().sort_values("i")  # a row a component
        return rows[names[1:]].to_numpy() / n

    return product


def against(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The columns of ``x`` without their parts along the orthonormal ``basis``."""
    for _ in range(2):  # the second time takes away what rounding left
        x = x - basis @ (basis.T @ x)
    return x


def orthonormal(basis: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Unit vectors that, with ``basis``, span what ``x`` adds to it."""
    added = basis[:, :0]
    for column in x.T:
        size = np.linalg.norm(column)
        if size == 0 or basis.shape[1] + added.shape[1] >= len(column):
            continue
        column = against(np.c_[basis, added], column[:, None] / size)[:, 0]
        left = np.linalg.norm(column)
        if left > 1e-10:
            added = np.c_[added, column / left]
    return added


def corrections(
    product: Product, locked: np.ndarray, values: np.ndarray, vectors: np.ndarray, residuals: np.ndarray
) -> np.ndarray:
    """Rough solutions of the correction equations of several pairs, by MINRES in step.

    Each pair has its own Lanczos recurrence and its own projector; the products of a step are made in
    one pass.
    """
    k = len(values)
    sides = [np.linalg.qr(np.c_[locked, vectors[:, [j]]])[0] for j in range(k)]

    def projected(x: np.ndarray) -> np.ndarray:
        return np.stack([against(sides[j], x[:, [j]])[:, 0] for j in range(k)], axis=1)

    v = projected(-residuals)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = np.where(live, v / np.where(live, beta, 1), 0)
    old_v, w, old_w, t = (np.zeros_like(v) for _ in range(4))
    eta, old_beta = beta.copy(), np.zeros(k)
    c = old_c = np.ones(k)
    s = old_s = np.zeros(k)
    for _ in range(INNER):
        if not live.any():
            break
        p = projected(product(v) - values * v)
        alpha = (v * p).sum(0)
        p = projected(p - alpha * v - old_beta * old_v)
        new_beta = np.linalg.norm(p, axis=0)
        # two old rotations, then the one that takes the new subdiagonal away
        delta = c * alpha - old_c * s * old_beta
        upper = s * alpha + old_c * c * old_beta
        far = old_s * old_beta
        size = np.hypot(delta, new_beta)
        live &= size > 1e-300
        safe = np.where(live, size, 1)
        new_c, new_s = delta / safe, new_beta / safe
        new_w = (v - far * old_w - upper * w) / safe
        t = np.where(live, t + new_c * eta * new_w, t)
        eta = np.where(live, -new_s * eta, eta)
        old_w, w = w, new_w
        old_c, c, old_s, s = c, new_c, s, new_s
        live &= new_beta > 1e-14 * np.maximum(1e-300, np.abs(values))
        old_v, v = v, np.where(live, p / np.where(live, new_beta, 1), 0)
        old_beta = new_beta
    return projected(t)


def leading(product: Product, dim: int, count: int, seed: int = 20240613) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues, falling, and their unit vectors (columns)."""
    count = min(count, dim)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    space = orthonormal(locked, rng.standard_normal((dim, min(dim, count + 4))))
    image = product(space)
    scale, last, idle = 0.0, np.inf, 0
    for _ in range(ROUNDS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        scale = max(scale, theta.max(initial=0))
        residual = against(locked, image - space * theta)
        error = np.linalg.norm(residual, axis=0)
        # from the largest on: a pair is locked only if all larger ones are
        zero = ULPS * np.finfo(float).eps * scale
        idle = 0 if not len(error) or error[0] < last / 2 else idle + 1
        last = error[0] if len(error) else np.inf
        if idle > 4:  # rounding keeps it from getting smaller
            zero = max(zero, 1e-12 * scale)
        done = int(np.argmin(np.r_[error <= zero, False]))
        if done:
            locked, values = np.c_[locked, space[:, :done]], np.r_[values, theta[:done]]
            space, image = space[:, done:], image[:, done:]
            theta, residual, error = theta[done:], residual[:, done:], error[done:]
            last, idle = np.inf, 0
        if locked.shape[1] == dim:
            break
        if len(values) >= count:
            least = np.sort(values)[::-1][count - 1]
            if len(theta) and theta[0] <= least and theta[0] + error[0] <= least * (1 + 1e-3):
                break
        wanted = min(max(1, count - len(values)), len(theta))
        if space.shape[1] + wanted > SPACE * count:
            space = space[:, : count + 2]
            theta, residual = theta[: count + 2], residual[:, : count + 2]
            image = product(space)  # anew, so that rounding does not add up
        fresh = rng.standard_normal((dim, 2))
        if wanted:
            fresh = corrections(product, locked, theta[:wanted], space[:, :wanted], residual[:, :wanted])
        added = orthonormal(np.c_[locked, space], fresh)
        if not added.shape[1]:
            added = orthonormal(np.c_[locked, space], rng.standard_normal((dim, 2)))
        if added.shape[1]:
            space, image = np.c_[space, added], np.c_[image, product(added)]
        else:  # the space is complete
            image = product(space)
    else:
        raise RuntimeError("the eigenvectors were not found to double precision")
    order = np.argsort(-values, kind="stable")[:count]
    return values[order], locked[:, order]


def fit(table: DataFrame, count: int = COMPONENTS) -> Fit:
    """Mean, trace and up to ``count`` leading components of the ``blocks`` of a stored table.

    Components whose variance is zero to double precision are left out.
    """
    n, sums, squares = moments(table)
    if not n:
        return Fit(0, (), 0.0, np.zeros(0), np.zeros((0, 0)))
    spread = sum(n * q - s * s for s, q in zip(sums, squares))  # exact
    trace = spread / (n * n)
    start = Fit(n, tuple(sums), trace, np.zeros(0), np.zeros((len(sums), 0)))
    if spread == 0 or not sums:
        return start
    passes = 0
    once = distributed(table, n, start.middle, start.rest)

    def counted(u: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return once(u)

    values, vectors = leading(counted, len(sums), count)
    real = values > ULPS * np.finfo(float).eps * values[0]
    return Fit(n, tuple(sums), trace, values[real], vectors[:, real], passes)


def projected(rows: DataFrame, model: Fit) -> DataFrame:
    """``rows`` (``id``, ``x``) with ``whitened`` (the components' values) and ``deviation``: the exact
    ``sum (n x - S)^2`` as a decimal."""
    if not model.n:
        return rows.select("id", F.array().cast("array<double>").alias("whitened"),
                           F.lit(None).cast("decimal(38,0)").alias("deviation"))
    n, dim, middle, rest = model.n, len(model.sums), model.middle, model.rest
    turn = model.vectors / np.sqrt(model.values)
    over = np.array([s - n * int(m) for s, m in zip(model.sums, middle)], object)
    square = int((over * over).sum())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, BLOCK // max(1, dim))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                y = filled(part["x"], dim) - middle
                w = (y - rest) @ turn
                own = y if np.abs(y).max(initial=0) < 1 << 20 else y.astype(object)
                first = (own * own).sum(1).tolist()
                wide = float(np.abs(y).max(initial=0)) * n * dim
                second = (y @ over.astype("i8") if wide < 1 << 62 else y.astype(object) @ over).tolist()
                exact = [n * n * int(p) - 2 * n * int(q) + square for p, q in zip(first, second)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.FixedSizeListArray.from_arrays(w.reshape(-1), w.shape[1]).cast(pa.list_(pa.float64()))
                        if w.shape[1] else pa.array([[]] * len(w), pa.list_(pa.float64())),
                        pa.array([str(v) for v in exact]),
                    ],
                    names=["id", "whitened", "deviation"],
                )

    found = rows.select("id", "x").mapInArrow(project, "id long, whitened array<double>, deviation string")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, in absolute value."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = batch["whitened"].flatten().to_numpy().reshape(-1, k)
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        columns = [pa.array(np.arange(k + 1), pa.int64()), *(pa.array(c) for c in np.ascontiguousarray(total.T))]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["i", *(f"v{j}" for j in range(k))]
    schema = ", ".join(["i long", *(f"{c} double" for c in names[1:])])
    sums = whitened.select("whitened").mapInArrow(add, schema)
    sums = sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in names[1:]])
    total = sums.toPandas().sort_values("i")[names[1:]].to_numpy() / n  # k + 1 rows
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row that has a
    vector and each of up to ``count`` components, numbered by falling variance.

    Components are of the vectors ``x = floor(1024 * c) + 100000``. Rows whose vector is null or holds an entry that
    is null or not finite are dropped; all others are fitted on and returned, repeated rows as often as
    they are there, rows with a null id too. Vectors that are shorter than the longest count as filled
    up with zeros. Components without variance are not returned, so equal vectors, a single one and an
    empty table give no rows. ``deviation`` is a decimal, as it outgrows 64 bits from some three million
    unit vectors on. Other columns are ignored.
    """
    rows = table.select(
        F.col(f"`{vec_id}`").cast("long").alias("id"), whole(F.col(f"`{vector}`")).alias("x")
    ).filter("x IS NOT NULL")
    model = fit(stored(blocks(rows), "vectors"), count)
    k = len(model.values)
    turned = stored(projected(rows, model), "whitened")
    error = identity_error(turned, model.n, k) if k else 0.0
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    each = turned.select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
