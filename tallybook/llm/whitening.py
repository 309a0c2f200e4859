"""Whitening of vectors by their leading components, which FEAST contour integration finds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import own, with_arrays, written

SCALE, SHIFT = 1024, 100_000
#: Entries from here on count as not finite: squares of their steps would leave exact sums.
WIDEST = float(1 << 31)
PART = 40
NEW = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def usable(vector: Column) -> Column:
    """A vector without null or non-finite entries."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WIDEST))


def steps_of(vectors: pa.Array, dims: int) -> np.ndarray:
    """Each entry c as floor(1024 c) + 100000."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat.reshape(-1, dims) * SCALE).astype(np.int64) + SHIFT


# --- the eigenproblem of one covariance, dims x dims, on the driver

def inertia(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: signs of D in L D L' with complete pivoting (one and two rows)."""
    a, positive = a.copy(), 0
    while len(a):
        m, alpha = len(a), (1 + 17 ** 0.5) / 8
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = np.unravel_index(int(off.argmax()), off.shape)
        if off[r, s] == 0:
            return positive + int((np.diag(a) > 0).sum())
        if diagonal[i] >= alpha * off[r, s]:
            rest = np.delete(np.arange(m), i)
            positive += int(a[i, i] > 0)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, i], a[i, rest]) / a[i, i]
        else:
            rest = np.delete(np.arange(m), [r, s])
            pair = a[np.ix_([r, s], [r, s])]
            positive += 1  # such a pair has one eigenvalue of each sign
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, [r, s])] @ np.linalg.solve(pair, a[np.ix_([r, s], rest)])
        a = (a + a.T) / 2
    return positive


def above(v: np.ndarray, shift: float) -> int:
    return inertia(v - shift * np.eye(len(v)))


def lower_edge(v: np.ndarray, wanted: int, top: float) -> tuple[float, int]:
    """A shift with `wanted` eigenvalues above it, or as few more as leave a gap around it, and their number."""
    dims = len(v)
    for m in range(wanted, dims):
        # between the m-th and the next eigenvalue, if bisection can tell them apart
        low, high = -1e-3 * top, top
        for _ in range(48):
            mid = (low + high) / 2
            count = above(v, mid)
            if count == m:
                # stretch the gap to both sides, so that the contour keeps away from either eigenvalue
                down, up = (low, mid), (mid, high)
                for _ in range(8):
                    x = sum(down) / 2
                    down = (down[0], x) if above(v, x) == m else (x, down[1])
                    x = sum(up) / 2
                    up = (x, up[1]) if above(v, x) == m else (up[0], x)
                return (down[1] + up[0]) / 2, m
            low, high = (mid, high) if count > m else (low, mid)
    return -1e-2 * top, dims


def upper_edge(v: np.ndarray, low: float, top: float) -> float:
    """A shift just above the largest eigenvalue, near it by the width of the interval."""
    inside, outside = low, top
    while outside - inside > 0.05 * (outside - low) and inside < (mid := (inside + outside) / 2) < outside:
        inside, outside = (mid, outside) if above(v, mid) else (inside, mid)
    return outside + 0.05 * (outside - low)


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = 16, rounds: int = 60) -> tuple[np.ndarray, np.ndarray] | None:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix inside (low, high).

    The resolvent is integrated over the circle through both ends by Gauss-Legendre nodes on its upper half: each node is
    one complex solve against the subspace, and their sum projects it onto the eigenvectors inside.  Rayleigh-Ritz on the
    result gives pairs, which are the next subspace, until their residuals are down to rounding.  None if they do not get there.
    """
    dims = len(v)
    size = min(dims, max(count + 4, (3 * count + 1) // 2))
    y = np.random.default_rng(12).standard_normal((dims, size))
    x, weight = np.polynomial.legendre.leggauss(nodes)
    centre, radius = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi / 2 * (1 + x))
    aim, best, same = np.finfo(float).eps * np.linalg.norm(v), None, 0
    for _ in range(rounds):
        q = np.zeros((dims, size))
        for t, w in zip(turn, weight, strict=True):
            q += (w / 2) * np.real(radius * t * np.linalg.solve((centre + radius * t) * np.eye(dims) - v, y.astype(complex)))
        basis, _ = np.linalg.qr(q)
        small = basis.T @ v @ basis
        value, turned = np.linalg.eigh((small + small.T) / 2)
        y = basis @ turned
        inside = np.flatnonzero((value > low) & (value < high))
        if len(inside) >= count:
            chosen = inside[np.argsort(-value[inside])][:count]
            rest = np.linalg.norm(v @ y[:, chosen] - y[:, chosen] * value[chosen], axis=0).max()
            if best is None or rest < best[0]:
                best, same = (rest, value[chosen], y[:, chosen]), 0
            else:
                same += 1
            if rest <= aim or same >= 3:
                break
    return best[1:] if best and best[0] <= 100 * aim else None


def leading_components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `wanted` eigenvalues, falling, and unit eigenvectors; fewer where the matrix has a lower rank.  Counts of
    signs at both ends of the interval say how many there are; as many must come back.  Where neighbours of the last one are
    too near for the contour, the interval takes them in too, at worst all eigenvalues."""
    top = float(np.abs(v).sum(axis=1).max()) * 1.01  # no eigenvalue lies above
    if top == 0:
        return np.empty(0), np.empty((len(v), 0))
    least, found = min(wanted, len(v)), None
    while found is None:
        low, count = lower_edge(v, least, top)
        high = upper_edge(v, low, top)
        found = feast(v, low, high, count)
        if found is None and count == len(v):
            raise ArithmeticError("contour integration did not settle")
        least = min(len(v), 2 * count)
    value, vector = found
    if not len(value) == count == above(v, low) - above(v, high):
        raise ArithmeticError("an eigenvalue is missing")
    positive = (value > len(v) * np.finfo(float).eps * top)[:wanted]
    return value[:wanted][positive], vector[:, :wanted][:, positive]


# --- the passes over the rows

def step_sums(vectors: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """Rows and, for each dimension, the sum of its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, dtype=np.int64)
        for batch in batches:
            x = steps_of(batch.column(0), dims)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(total, pa.int64())], ["dim", "n", "total"])

    found = vectors.mapInArrow(run, "dim int, n long, total long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # one row per dimension
    out = np.zeros(dims, dtype=object)
    for row in found:
        out[row.dim] = int(row.total)
    return int(found[0].n), out


def product_sums(vectors: DataFrame, dims: int, centre: np.ndarray) -> np.ndarray:
    """Exact sums of products of steps less a whole-number centre, as Python integers.  A task sends one number per pair of
    dimensions, in two parts that cannot overflow."""
    upper = np.triu_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = np.zeros((2, len(upper[0])), dtype=np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                d = steps_of(batch.slice(lo, 4096).column(0), dims) - centre
                if len(d) and np.abs(d).max() < 1 << 20:
                    product = (d.astype(np.float64).T @ d.astype(np.float64))[upper].astype(np.int64)  # below 2**52: exact
                else:
                    product = (d.astype(object).T @ d.astype(object))[upper] if len(d) else np.zeros(len(upper[0]), dtype=np.int64)
                parts += np.array([product >> PART, product & ((1 << PART) - 1)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts[0])), pa.int32()), pa.array(parts[0]), pa.array(parts[1])], ["cell", "high", "low"])

    found = vectors.mapInArrow(run, "cell int, high long, low long").groupBy("cell").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = np.zeros((dims, dims), dtype=object)
    for row in found.collect():  # one row per pair of dimensions
        i, j = upper[0][row.cell], upper[1][row.cell]
        out[i, j] = out[j, i] = (int(row.high) << PART) + int(row.low)
    return out


def identity_error(rows: DataFrame, column: str, count: int) -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity, summed over the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, count)
            n, total, product = n + len(w), total + w.sum(axis=0), product + w.T @ w
        values = np.concatenate([[float(n)], total, product.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], ["cell", "value"])

    found = np.zeros(1 + count + count * count)
    for row in rows.select(column).mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        found[row.cell] = row.value
    mean = found[1 : 1 + count] / found[0]
    return float(np.abs(found[1 + count :].reshape(count, count) / found[0] - np.outer(mean, mean) - np.eye(count)).max())


def whiten(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each row of `vectors` that can be used and each leading component: component (from 1, by falling
    eigenvalue), n, deviation, whitened, explained and identity_error.

    Rows whose vector is null or holds a null or non-finite entry are dropped; entries of 2**31 and more count as such.  All
    others are the fit list.  Entries become whole steps, floor(1024 c) + 100000, so sums and products of centred steps are
    exact, whatever the order of tasks.  The covariance (dims x dims) is decomposed on the driver by FEAST: an interval that
    holds the wanted eigenvalues and keeps off its neighbours is found by inertia counts, contour integration of shifted
    solves projects onto it, Rayleigh-Ritz extracts the pairs, and the counts at both ends confirm that none is missed.

    Three passes add up one row per task and dimension, pair of dimensions or pair of components; the fourth projects.  No
    vector leaves its task.  deviation is null where it does not fit a long.

    Vectors of another length than most (of two as common, the longer) have no projection and are dropped.  Components are
    as many as asked, at most the rank: equal vectors alone have none and give no row.  Where two eigenvalues tie, any basis
    of theirs is taken, the same for all rows.  Repeated rows each count and return.  An empty table gives an empty one.
    Columns of `vectors` named like a new one are replaced; the others, without the vector, come through unchanged.
    """
    vector, projected = own("vector", "projected")
    columns = [c for c in vectors.columns if c.lower() not in NEW and c.lower() != vector_col.lower()]
    wide = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.filter(usable(wide)).select(*[F.col(f"`{c}`") for c in columns], wide.alias(vector))
    # one row per length of vector
    lengths = rows.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = lengths["dims"] if lengths else 0
    value = explained = np.empty(0)
    if dims:
        rows = rows.filter(F.size(vector) == dims)
        n, total = step_sums(rows.select(vector), dims)
        centre = np.array([int(t) // n for t in total], dtype=np.int64)
        off = np.array([int(t) - n * int(c) for t, c in zip(total, centre, strict=True)], dtype=object)  # 0 to n - 1 each
        products = product_sums(rows.select(vector), dims, centre)
        # n * products - off off' is whole; one division each makes the covariance
        covariance = np.array([[(n * int(products[i, j]) - int(off[i]) * int(off[j])) / (n * n) for j in range(dims)] for i in range(dims)])
        value, basis = leading_components(covariance, components)
        explained = value / np.trace(covariance)
    found = [F.col(f"`{c}`") for c in columns]
    if not len(value):
        none = [F.lit(None).cast(t).alias(c) for c, t in zip(NEW, ("int", "long", "long", "double", "double", "double"), strict=True)]
        return rows.filter(F.lit(False)).select(*found, *none)

    offset, square = off.astype(np.float64) / n, int((off * off).sum())
    axes = basis / np.sqrt(value)

    def work(batch: pa.Array) -> dict[str, pa.Array]:
        d = steps_of(batch, dims) - centre
        exact = d.astype(object) if len(d) and np.abs(d).max() >= 1 << 24 else d
        squares, along = (exact * exact).sum(axis=1), (d.astype(object) * off).sum(axis=1) if n >= 1 << 32 or exact is not d else d @ off.astype(np.int64)
        deviation = [n * n * int(a) - 2 * n * int(b) + square for a, b in zip(squares, along, strict=True)]
        white = (d - offset) @ axes
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, white.size + 1, len(value)), pa.int32()), pa.array(white.ravel()))
        return {"deviation": pa.array([x if x < 1 << 63 else None for x in deviation], pa.int64()), projected: lists}

    rows = written(with_arrays(rows, work, [vector], {"deviation": "long", projected: "array<double>"}, at_once=4096))
    error = identity_error(rows, projected, len(value))
    shares = F.array(*[F.lit(float(x)) for x in explained])
    rows = rows.select(*found, "deviation", F.posexplode(projected).alias("component", "whitened"))
    return rows.select(*found, (F.col("component") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("component") + 1).alias("explained"), F.lit(error).alias("identity_error"))
