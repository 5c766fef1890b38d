"""Whitening of embeddings by spectrum slicing.

Entries become integers, so counts and sums are exact, and every value is centred before
it is multiplied. The covariance is a matrix of dims x dims; tasks send Gram matrices of
their own rows, row by row, which are added up in two levels.

Its leading components come from slicing the spectrum. The factors L D Lᵀ of the
covariance less a shift have as many positive pivots as it has eigenvalues above the shift
(`above`). Counts halve an interval until each piece holds one eigenvalue; inverse
iteration and then Rayleigh quotient iteration, which converges cubically, turn a piece
into its eigenvalue and vector, accepted only inside the piece. Eigenvalues that no count
can tell apart (equal to rounding) share a piece and get orthogonal vectors of it. At the
end counts between neighbours certify that component k has k - 1 eigenvalues above it.

Defined results: rows whose vector is null, or has a null or non-finite entry, are left
out, empty ones too; vectors of each length are fitted among themselves, as a covariance
takes one length; components whose eigenvalue isn't above rounding (fewer vectors than
dimensions, constant or repeated dimensions) can't be whitened and are left out, so a
single vector gives no rows; repeated rows and rows with equal or null ids are rows each;
64 times an entry is held within 2^61, so x is a long; a deviation that no long can hold
is null; an empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeframe.llm import common

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
HELD = float(2**61)
#: Partial matrices that are added up in one group at first, and entries that a task takes at a time.
FAN, CELLS = 512, 1 << 20
#: The models of all lengths go to every task; more than this is refused.
MODEL_BYTES = 64 << 20
_ALPHA = (1 + 17**0.5) / 8
_EPS = float(np.finfo(float).eps)


def quantised(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """`vec_id` and `x`, the integer entries, of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    held = lambda c: F.greatest(F.lit(-HELD), F.least(F.lit(HELD), c.cast("double") * SCALE))
    df = df.filter(v.isNotNull() & (F.size(v) > 0) & finite)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(held(c)) + SHIFT).alias("x"))


# --- Spectrum slicing of one symmetric matrix.


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric matrix above a shift: the positive ones among the pivots of L D Lᵀ, with the pivoting of Bunch and Kaufman."""
    a = a - shift * np.eye(len(a))
    count = 0
    while len(a):
        own = abs(a[0, 0])
        r = int(np.abs(a[1:, 0]).argmax()) + 1 if len(a) > 1 else 0
        off = abs(a[r, 0]) if r else 0.0
        swap, two = 0, False
        if own < _ALPHA * off:
            column = np.abs(a[:, r])
            column[r] = 0
            if own * column.max() < _ALPHA * off * off:
                swap, two = r, abs(a[r, r]) < _ALPHA * column.max()
        at = int(two)
        if swap != at and swap:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        if two:  # an indefinite block of two: one eigenvalue on either side
            count += 1
            left = a[2:, :2]
            a = a[2:, 2:] - left @ np.linalg.solve(a[:2, :2], left.T)
        else:
            pivot = a[0, 0]
            count += int(pivot > 0)
            a = a[1:, 1:] - np.outer(a[1:, 0] / pivot, a[0, 1:]) if pivot else a[1:, 1:]
    return count


def _solved(a: np.ndarray, shift: float, x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """A step of inverse iteration, orthogonal to `others`, of length 1."""
    eye = np.eye(len(a))
    try:
        y = np.linalg.solve(a - shift * eye, x)
    except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
        y = np.linalg.solve(a - (shift + 4 * _EPS * np.abs(a).sum(1).max()) * eye, x)
    y = y / np.abs(y).max()
    for _ in range(2):
        for o in others:
            y = y - o * (o @ y)
        y = y / np.linalg.norm(y)
    return y


def _in_piece(a: np.ndarray, low: float, high: float, number: int, start: np.ndarray, others: list[np.ndarray], tol: float) -> tuple[float, np.ndarray]:
    """The eigenvalue of that number, the only one between low and high, with its vector."""
    while True:
        y, middle = start, (low + high) / 2
        for _ in range(2):
            y = _solved(a, middle, y, others)
        for _ in range(8):
            rho = float(y @ a @ y)
            if np.linalg.norm(a @ y - rho * y) <= tol:
                break
            y = _solved(a, rho, y, others)
        rho = float(y @ a @ y)
        if low - tol <= rho <= high + tol and np.linalg.norm(a @ y - rho * y) <= 4 * tol or high - low <= tol:
            return rho, y
        low, high = (middle, high) if above(a, middle) >= number else (low, middle)


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues above rounding, falling, and their unit vectors as rows."""
    norm = float(np.abs(a).sum(1).max(initial=0.0))
    tol = max(len(a), 16) * _EPS * norm
    pieces, todo = [], [(8 * tol, norm + tol, above(a, 8 * tol), 0)] if norm > 0 else []
    while todo:
        low, high, lower, upper = todo.pop()
        if lower == upper or upper >= most:
            continue
        if lower - upper == 1 or high - low <= tol:
            pieces.append((low, high, lower, upper))
            continue
        middle = (low + high) / 2
        count = above(a, middle)
        todo += [(low, middle, lower, count), (middle, high, count, upper)]
    rng = np.random.default_rng(11)
    values, vectors = [], []
    for low, high, lower, upper in sorted(pieces, key=lambda p: p[3]):
        for number in range(upper + 1, lower + 1):
            start = rng.normal(size=len(a))
            if lower - upper == 1:
                value, y = _in_piece(a, low, high, number, start, vectors, tol)
            else:
                y = start
                for _ in range(4):
                    y = _solved(a, low - tol * 1.5, y, vectors)
                value = float(y @ a @ y)
            values.append(value)
            vectors.append(y)
    values, vectors = np.array(values), np.array(vectors).reshape(-1, len(a))
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[order]
    for k in range(len(values)):
        if k + 1 < len(values) and values[k] - values[k + 1] > 8 * tol and above(a, (values[k] + values[k + 1]) / 2) != k + 1:
            raise ArithmeticError(f"component {k + 1} of the covariance is not the one of that number")
    return values, vectors


# --- Moments of the vectors, from Arrow batches in tasks.


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and entries of rows of one length, CELLS entries at most at a time."""
    for b in batches:
        lists = b.column("x")
        sizes = lists.value_lengths().to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            step = max(1, CELLS // int(sizes[x])) if x < y else 1
            for at in range(x, y, step):
                n = min(step, y - at)
                yield b.column("vec_id").slice(at, n), lists.slice(at, n).flatten().to_numpy().reshape(n, -1)


_SUMS = "dims long, n long, high array<long>, low array<long>"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: number of vectors and sums of the upper and lower halves of their entries, which no number of rows under 2^31 overflows."""
    held: dict[int, list] = {}
    for _, x in _matrices(batches):
        own = held.setdefault(x.shape[1], [0, 0, 0])
        own[0] += len(x)
        own[1] = own[1] + (x >> 32).sum(0)
        own[2] = own[2] + (x & 0xFFFFFFFF).sum(0)
    columns = list(zip(*[(d, n, h, low) for d, (n, h, low) in held.items()], strict=True)) or [(), (), (), ()]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["dims", "n", "high", "low"])


@dataclass
class Space:
    """The vectors of one length: their number, exact sums, the whole part of the means, and later components over root eigenvalues."""

    n: int
    sums: list[int]
    project: np.ndarray | None = None
    explained: np.ndarray | None = None
    error: float = 0.0

    def __post_init__(self) -> None:
        self.base = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the means: the difference of integers first, so nothing is rounded but the last step."""
        return (x - self.base).astype(float) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.project

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sums of (n * x - S)^2, in integers; null where no long holds it."""
        about = np.square(self.centred(x) * self.n).sum(1)
        d = x - self.base
        if about.max(initial=0) < 2.0**62:
            return pa.array(np.square(self.n * d - self.rest).sum(1))
        exact = [sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, self.rest, strict=True)) if s < 2.0**64 else 2**63 for row, s in zip(d, about, strict=True)]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


_CELLS = pa.schema([("dims", pa.int64()), ("row", pa.int64()), ("part", pa.int64()), ("cells", pa.list_(pa.float64()))])
_CELLS_DDL = "dims long, row long, part long, cells array<double>"


def _gram(values: Callable[[np.ndarray], np.ndarray]):
    """A task's sums of products of all columns of values(x), one row of the matrix a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), {}
        for _, x in _matrices(batches):
            w = values(x)
            held[x.shape[1]] = held.get(x.shape[1], 0) + w.T @ w
        for d, g in held.items():
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1, dtype=np.int32) * len(g)), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), d)), pa.array(np.arange(len(g))), pa.array(np.full(len(g), part)), cells], schema=_CELLS)

    return run


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """The rows of a group added up, in the order of their parts."""
    table = table.sort_by("part")
    total = table.column("cells").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
    return pa.Table.from_arrays([pa.array([k.as_py()], pa.int64()) for k in key] + [pa.array([total], pa.list_(pa.float64()))], schema=_CELLS)


def _matrix_of(rows: DataFrame, values: Callable[[np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Per length the Gram matrix of values(x) over all vectors: some dims x dims numbers."""
    parts = rows.mapInArrow(_gram(values), _CELLS_DDL)
    some = parts.withColumn("group", F.floor(F.col("part") / FAN).cast("long")).groupBy("dims", "row", "group")
    some = some.applyInArrow(lambda key, t: _added(key, t.drop_columns("group")), _CELLS_DDL)
    one = some.withColumn("group", F.lit(0).cast("long")).groupBy("dims", "row", "group").applyInArrow(lambda key, t: _added(key, t.drop_columns("group")), _CELLS_DDL)
    out: dict[int, dict] = {}
    for r in one.select("dims", "row", "cells").collect():
        out.setdefault(r["dims"], {})[r["row"]] = r["cells"]
    return {d: np.array([m[k] for k in range(len(m))]) for d, m in out.items()}


def fitted(rows: DataFrame, most: int = COMPONENTS) -> dict[int, Space]:
    """The whitening of the vectors of each length. What reaches the driver are sums and matrices, whose size hangs on the lengths alone."""
    sums = rows.mapInArrow(_sums, _SUMS).select("dims", "n", F.posexplode(F.arrays_zip("high", "low")).alias("k", "s"))
    sums = sums.groupBy("dims", "k").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    of: dict[int, list] = {}
    for r in sorted(sums.collect(), key=lambda r: (r["dims"], r["k"])):
        of.setdefault(r["dims"], []).append((r["n"], (r["high"] << 32) + r["low"]))
    spaces = {d: Space(s[0][0], [x for _, x in s]) for d, s in of.items()}
    if sum(8 * d * (most + 3) for d in spaces) > MODEL_BYTES:
        raise ValueError("the components of all lengths are too many for every task to hold")
    for d, g in _matrix_of(rows, lambda x: spaces[x.shape[1]].centred(x)).items():
        v = (g + g.T) / (2 * spaces[d].n)
        values, vectors = leading(v, most)
        spaces[d].project, spaces[d].explained = (vectors / np.sqrt(values)[:, None]).T, values / np.trace(v)
    with_one = lambda x: np.hstack([spaces[x.shape[1]].whitened(x), np.ones((len(x), 1))])
    for d, g in _matrix_of(rows, with_one).items():
        mean = g[:-1, -1] / spaces[d].n
        spaces[d].error = float(np.abs(g[:-1, :-1] / spaces[d].n - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0.0))
    return spaces


_OUT = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
_OUT_DDL = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    common.ship(vectors.sparkSession)
    rows = quantised(vectors, vec_id, vector)
    spaces = fitted(rows, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches):
            s = spaces[x.shape[1]]
            w, dev = s.whitened(x), s.deviation(x)
            k = w.shape[1]
            each = pa.array(np.repeat(np.arange(len(x)), k))
            columns = [ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, s.n)), dev.take(each), pa.array(w.ravel()), pa.array(np.tile(s.explained, len(x))), pa.array(np.full(len(x) * k, s.error))]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    return rows.mapInArrow(run, _OUT_DDL)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in the 32 leading components of their covariance, each of variance 1."""
    return whiten(common.table(spark, sf_dir, "embeddings"))


#: Eigenvectors are beyond SQL; tests hold the result against a dense eigenvalue solver.
SQL = None
