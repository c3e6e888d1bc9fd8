"""Joins of every row with every row where neither side can be held by all tasks.

Both sides are dealt into blocks of at most some ``CELL_NUMBERS`` numbers, by a hash of their
ids, and each block of one side meets each block of the other in a cell of a grid. A cell's work
is one array kernel; its inputs are bounded, and what leaves it is either all pairs, where
all are wanted, or the k best of every query. So there is no Cartesian product of rows, and
a query's answers are at most k rows a block of objects before the last shuffle. A side is copied
once for every block of the other one, which is the price of not holding it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship

#: Numbers in a block's vectors, give or take what hashing deals unevenly, and rows a step.
CELL_NUMBERS, STEP = 2_000_000, 512
#: Scores that a step makes, and those of a tile, which all dimensions pass before the next one.
STEP_SCORES, TILE = 4_000_000, 1 << 16
#: Of a step's pairs, the share whose scores are made one by one at most; beyond it all are made at once.
CHOSEN = 1 / 8
#: Score types of Spark and NumPy.
KINDS = {"double": "f8", "float": "f4", "long": "i8"}


def blocks(numbers: int) -> int:
    return max(1, -(-numbers // CELL_NUMBERS))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _steps(x: np.ndarray, y: np.ndarray, term: Callable[[np.ndarray], None], kind: str) -> np.ndarray:
    """Sums of ``term`` of the differences over the dimensions, in order, so that ties are those
    of column folds. Tiles of the scores stay in a core's cache while all dimensions are added;
    ``term`` works in place."""
    out = np.zeros((len(x), len(y)), kind)
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    wide = max(1, TILE // max(1, out.shape[0]))
    for at in range(0, out.shape[1], wide):
        total = np.zeros((out.shape[0], min(wide, out.shape[1] - at)), kind)
        step = np.empty(total.shape, np.result_type(x, y))
        for a, b in zip(x, y, strict=True):
            np.subtract(a[:, None], b[None, at : at + wide], out=step)
            term(step)
            total += step if step.dtype == total.dtype else step.astype(kind)
        out[:, at : at + wide] = total
    return out


def _square(d: np.ndarray) -> None:
    np.multiply(d, d, out=d)


def _size(d: np.ndarray) -> None:
    np.abs(d, out=d)


def _floats(x: np.ndarray) -> np.ndarray:
    return x.astype("f8", copy=False)


def _single(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squares of differences below 2^12 are exact as single floats, so these may be so at once."""
    if all(not z.size or np.abs(z).max() < 2048 for z in (x, y)):
        x, y = x.astype("f4"), y.astype("f4")
    return np.sqrt(_steps(x, y, _square, "f4"))


def _ranks(n: int) -> str:
    """The type for sums of displacements of n ranks, which stay below n * n / 2."""
    return "i2" if n < 180 else "i8"


def _footrule(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    kind = _ranks(x.shape[1])
    return _steps(x.astype(kind), y.astype(kind), _size, kind)


def _looked_up(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Permutations by rank against positions by pivot: each symbol looks up, for all queries of a
    tile, how far its query rank is from its own."""
    kind = _ranks(x.shape[1])
    out, ranks = np.zeros((len(x), len(y)), kind), np.ascontiguousarray(y.T.astype(kind))
    wide = max(1, TILE // max(1, len(x)))
    for at in range(0, len(y), wide):
        total = np.zeros((len(x), min(wide, len(y) - at)), kind)
        for i in range(x.shape[1]):
            total += np.abs(ranks[:, at : at + wide] - np.array(i, kind))[x[:, i]]
        out[:, at : at + wide] = total
    return out


#: Scores of all rows of x with all rows of y, as the column expressions of the same names.
KERNELS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "squared_l2": lambda x, y: _steps(_floats(x), _floats(y), _square, "f8"),
    "l2": lambda x, y: np.sqrt(_steps(_floats(x), _floats(y), _square, "f8")),
    "l1": lambda x, y: _steps(_floats(x), _floats(y), _size, "f8"),
    "l2_single": _single,
    "footrule": _footrule,
    "rank_footrule": _looked_up,
}


def _near(x: np.ndarray, y: np.ndarray, edge: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of rows that may be within Euclidean distance ``edge[j]`` of ``y[j]``, by one matrix product;
    none of them is missing: the limits are widened by what the product, and the scores (of precision
    ``eps``), can err by rounding. None where that can't be told."""
    x, y, n = x.astype("f8"), y.astype("f8"), x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        limit = edge.astype("f8") ** 2 * (1 + 8 * (n + 4) * eps)
        xx, yy = (np.einsum("ij,ij->i", z, z) for z in (x, y))
        limit += 8 * (n + 4) * np.finfo("f8").eps * (xx.max() + yy + limit)
        if not (np.isfinite(limit).all() and limit.max() + xx.max() + yy.max() < 1e300):
            return None
    x = np.concatenate([-2 * x, xx[:, None], np.ones((len(x), 1))], 1)
    y = np.concatenate([y, np.ones((len(y), 1)), (yy - limit)[:, None]], 1)
    at = np.flatnonzero(x @ y.T <= 0)
    return (at // len(y), at % len(y)) if len(at) <= CHOSEN * len(x) * len(y) else None


def _chosen(x: np.ndarray, y: np.ndarray, row: np.ndarray, q: np.ndarray, kernel: str) -> np.ndarray:
    """The kernel's scores of some pairs, bit for bit: dimensions are added in the same order."""
    kind = "f8" if kernel == "l2" else "f4"
    if kernel == "l2":
        x, y = _floats(x), _floats(y)
    out = np.empty(len(row), kind)
    for at in range(0, len(row), STEP):
        d = x[row[at : at + STEP]] - y[q[at : at + STEP]]
        _square(d)
        out[at : at + STEP] = np.add.accumulate(d.astype(kind, copy=False), 1, kind)[:, -1] if d.shape[1] else 0
    return np.sqrt(out)


class Best:
    """The k smallest (score, id) of many queries, from blocks of scores."""

    def __init__(self, n: int, k: int, kind: str = "i8"):
        self.k, self.edge = k, np.full(n, np.inf if kind[0] == "f" else np.iinfo(kind).max, kind)
        self.q, self.s, self.i = np.empty(0, "i8"), np.empty(0, kind), np.empty(0, "i8")
        self.new, self.n, self.bounded = [], 0, False

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """``scores[row, query]``; what is over a query's k-th smallest, so far or among these, goes at once."""
        if not self.bounded and len(scores) >= self.k:
            self.edge = np.minimum(self.edge, np.partition(scores, self.k - 1, 0)[self.k - 1].astype(self.edge.dtype))
            self.bounded = True
        edge = self.edge if scores.dtype.kind == "f" else np.minimum(self.edge, np.iinfo(scores.dtype).max).astype(scores.dtype)
        row, q = np.nonzero(scores <= edge)
        self.put(q, scores[row, q], ids[row])

    def put(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(q):
            self.new.append((q, scores.astype(self.s.dtype, copy=False), ids))
            self.n += len(q)
        if self.n > 3 * max(len(self.q), 4096):
            self.settle()

    def settle(self) -> None:
        all_q, all_s, all_i = (np.concatenate(c) for c in zip((self.q, self.s, self.i), *self.new, strict=True))
        self.new, self.n = [], 0
        order = np.lexsort((all_i, all_s, all_q))
        q, s = all_q[order], all_s[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, "i8")
        size = np.diff(np.r_[start, len(q)])
        keep = np.arange(len(q)) - np.repeat(start, size) < self.k
        full = size >= self.k
        self.edge[q[start[full]]] = s[start[full] + self.k - 1]
        self.q, self.s, self.i = q[keep], s[keep], all_i[order][keep]

    def scan(self, ids: np.ndarray, x: np.ndarray, y: np.ndarray, kernel: str) -> None:
        """All rows of ``x`` with all queries ``y``, so many a step that the scores stay bounded. Once every
        query has k rows, Euclidean scores are made of the pairs alone that may be under its k-th."""
        step = max(1, min(STEP, STEP_SCORES // max(1, len(y))))
        near = len(y) and (kernel == "l2" or (kernel == "l2_single" and x.dtype.kind == y.dtype.kind == "i"))
        for at in range(0, len(x), step):
            own, few = x[at : at + step], None
            if near and np.isfinite(self.edge).all():
                few = _near(own, y, self.edge, np.finfo(self.s.dtype).eps)
            if few is None:
                self.add(ids[at : at + step], KERNELS[kernel](own, y))
                continue
            row, q = few
            scores = _chosen(own, y, row, q, kernel)
            under = scores <= self.edge[q]
            self.put(q[under], scores[under], ids[at : at + step][row[under]])


def _dealt(left: DataFrame, right: DataFrame, n_left: int, n_right: int):
    """Both sides, ``(id, x)`` and ``(id, y)``, as groups of cells."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    x = left.select("id", "x", mine(n_left).alias("a")).withColumn("b", every(n_right))
    y = right.select("id", "y", mine(n_right).alias("b")).withColumn("a", every(n_left))
    return x.groupBy("a", "b").cogroup(y.groupBy("a", "b"))


def all_pairs(left: DataFrame, right: DataFrame, n_left: int, n_right: int, kernel: str, kind: str = "double") -> DataFrame:
    """``(left, right, score)`` of every row of ``(id, x)`` with every row of ``(id, y)``."""
    ship(left.sparkSession)

    def cell(x: pa.Table, y: pa.Table) -> Iterator[pa.RecordBatch]:
        score = KERNELS[kernel]
        if x.num_rows and y.num_rows:
            ids, a, b = y["id"].to_numpy(), matrix(x["x"]), matrix(y["y"])
            for at in range(0, len(a), STEP):
                own = x["id"][at : at + STEP].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, len(ids))), pa.array(np.tile(ids, len(own))), pa.array(score(a[at : at + STEP], b).ravel())], ["left", "right", "score"])

    def gathered(x: pa.Table, y: pa.Table) -> pa.Table:
        found = list(cell(x, y))
        return pa.Table.from_batches(found) if found else pa.table({"left": pa.array([], pa.int64()), "right": pa.array([], pa.int64()), "score": pa.array([], pa.float64() if kind == "double" else pa.float32())})

    return _dealt(left, right, n_left, n_right).applyInArrow(gathered, f"left long, right long, score {kind}")


def nearest(objects: DataFrame, queries: DataFrame, n_objects: int, n_queries: int, k: int, kernel: str, kind: str) -> DataFrame:
    """``(q_id, obj_id, score)``: of every cell the k best of each query. ``kind`` is the score's
    Spark type."""
    ship(objects.sparkSession)

    def cell(x: pa.Table, y: pa.Table) -> pa.Table:
        best = Best(y.num_rows, k, KINDS[kind])
        if x.num_rows and y.num_rows:
            best.scan(x["id"].to_numpy(), matrix(x["x"]), matrix(y["y"]), kernel)
            best.settle()
        ids = y["id"].to_numpy() if y.num_rows else np.empty(0, "i8")
        return pa.table({"q_id": pa.array(ids[best.q], pa.int64()), "obj_id": pa.array(best.i, pa.int64()), "score": pa.array(best.s)})

    return _dealt(objects, queries, n_objects, n_queries).applyInArrow(cell, f"q_id long, obj_id long, score {kind}")


def scanned(objects: DataFrame, queries: DataFrame, k: int, kernel: str, kind: str) -> DataFrame:
    """The same of every task, for queries that all tasks can hold (the caller knows): objects are
    read once, where they lie."""
    spark = objects.sparkSession
    ship(spark)
    asked = queries.toArrow()
    shared = spark.sparkContext.broadcast((asked["id"].to_numpy(), matrix(asked["y"])) if asked.num_rows else None)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        q_ids, y = shared.value
        best = Best(len(q_ids), k, KINDS[kind])
        for b in batches:
            if b.num_rows:
                best.scan(b.column("id").to_numpy(), matrix(b.column("x")), y, kernel)
        best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[best.q], pa.int64()), pa.array(best.i, pa.int64()), pa.array(best.s)], ["q_id", "obj_id", "score"])

    return objects.select("id", "x").mapInArrow(scan, f"q_id long, obj_id long, score {kind}")


def scored(objects: DataFrame, queries: DataFrame, kernel: str, kind: str) -> DataFrame:
    """``(q_id, obj_id, score)`` of all pairs, for queries that all tasks can hold. Pairs leave a task
    in bounded batches, and none is kept."""
    spark = objects.sparkSession
    ship(spark)
    asked = queries.toArrow()
    shared = spark.sparkContext.broadcast((asked["id"].to_numpy(), matrix(asked["y"])) if asked.num_rows else None)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or shared.value is None:
                continue
            (q_ids, y), ids, x = shared.value, b.column("id").to_numpy(), matrix(b.column("x"))
            step = max(1, min(STEP, STEP_SCORES // 4 // len(y)))
            for at in range(0, len(x), step):
                own = ids[at : at + step]
                found = KERNELS[kernel](x[at : at + step], y).ravel().astype(KINDS[kind], copy=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(q_ids, len(own))), pa.array(np.repeat(own, len(y))), pa.array(found)], ["q_id", "obj_id", "score"])

    return objects.select("id", "x").mapInArrow(score, f"q_id long, obj_id long, score {kind}")
