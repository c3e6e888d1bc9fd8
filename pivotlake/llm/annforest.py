"""Approximate nearest neighbours: a forest of random-projection trees, searched through one
priority queue over all trees, with exact reranking of the candidates in the leaves.

Every tree halves its rows, level by level, at the median of a random projection; the nodes
of a level share the projection and have medians of their own. Trees are as deep as the rows
ask for, so that leaves hold about ``LEAF`` rows at any table size. Medians come from a bounded
sample (``SAMPLE`` vectors), but every row is put into its leaf of every tree. A query's
queue holds nodes of all trees by the sum of squared margins by which the query lies on the
other side; leaves are taken in that order until they hold ``share`` of the rows, counted over
all trees. Leaf members are compared exactly, in double precision.

``share`` sets recall against work. If none is given it is measured: ``QUERIES`` vectors of the
sample are compared with all of the sample, and the share is the smallest at which the forest
finds ``TARGET`` of their neighbours. So clustered vectors are searched in a small part, which
falls as the table grows; directions without any structure, where no tree can part near from
far, in a large one. Neighbours in the whole table are nearer than in a sample of it, so the
share of a sample is enough.

Equal vectors are held once, with their ``k + 1`` smallest ids: no more of them can be among
anybody's ``k`` nearest. So a vector that a third of the rows share is one member of a leaf.
Leaves too large for a task are dealt by a hash into parts, and so are the queries that meet in
a leaf; each part of one meets each part of the other.

Defined results: vectors that are null, of zero length, holding null or non-finite numbers,
or of another than the commonest dimension take no part, nor do rows without an id; repeated
rows count once; if an id has several vectors, its best score counts; ties, of scaled vectors
too, go to the smaller id; queries with fewer candidates return them all; an empty table gives
an empty table. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import lean, materialize, table

K = 5
TREES = 8
#: Rows of a leaf, as near as a power of two comes; vectors of the sample in each, at least.
LEAF, LEAST = 500, 4
#: Vectors, and numbers in them, that the trees are fitted on at most.
SAMPLE, SAMPLE_NUMBERS = 65_536, 8_000_000
#: Sampled queries from which the share is measured, and the recall they must reach.
QUERIES, TARGET = 256, 0.96
#: Cosines that one product of queries and members holds at most.
PRODUCT = 4_000_000
#: Vectors of one leaf, and queries, that one task compares at most (queries as expected).
LEAF_PART, QUERY_PART = 20_000, 50_000


class Forest:
    """Trees in heap order: children of node n are 2n + 1 and 2n + 2; leaves come last."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth = max(1, min(round(math.log2(max(rows / leaf, 2))), int(math.log2(max(len(sample) / LEAST, 2)))))
        self.trees, self.rows, self.inner = trees, rows, 2**self.depth - 1
        normals = rng.standard_normal((trees * self.depth, sample.shape[1]))
        self.normals = (normals / np.linalg.norm(normals, axis=1, keepdims=True)).T
        self.cuts = np.zeros((trees, self.inner))
        self.sizes = np.zeros((trees, self.inner + 1))
        seen = self.project(sample)
        for t in range(trees):
            node = np.zeros(len(sample), dtype=int)
            for level in range(self.depth):
                p = seen[:, t, level]
                order = np.lexsort((p, node))
                first = np.searchsorted(node[order], np.arange(2**level - 1, 2 ** (level + 1) - 1))
                last = np.append(first[1:], len(order))
                some = last > first
                at = lambda k: p[order[np.minimum(k, len(order) - 1)]]
                self.cuts[t, 2**level - 1 : 2 ** (level + 1) - 1] = np.where(some, (at((first + last - 1) // 2) + at((first + last) // 2)) / 2, 0.0)
                node = 2 * node + 1 + (p > self.cuts[t, node])
            self.sizes[t] = np.bincount(node - self.inner, minlength=self.inner + 1) * (rows / max(len(sample), 1))

    def project(self, x: np.ndarray) -> np.ndarray:
        """Row, tree and level to the projection."""
        return (x @ self.normals).reshape(len(x), self.trees, self.depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree, numbered through the forest."""
        seen, out = self.project(x), np.empty((len(x), self.trees), dtype="i8")
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=int)
            for level in range(self.depth):
                node = 2 * node + 1 + (seen[:, t, level] > self.cuts[t, node])
            out[:, t] = node - self.inner + t * (self.inner + 1)
        return out

    def search(self, q: np.ndarray, share: float) -> list[int]:
        """Leaves for one query, in the order of the shared queue."""
        seen = self.project(q[None])[0]
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        out, held, want = [], 0.0, share * self.rows
        while queue and held < want:
            far, t, level, n = heapq.heappop(queue)
            while level < self.depth:  # the near child comes next in the queue, the far one later
                m = seen[t, level] - self.cuts[t, n]
                heapq.heappush(queue, (far + m * m, t, level + 1, 2 * n + 1 + int(m <= 0)))
                level, n = level + 1, 2 * n + 1 + int(m > 0)
            out.append(n - self.inner + t * (self.inner + 1))
            held += self.sizes[t, n - self.inner]
        return out

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Of every leaf the sum by which the queue is ordered, for one query."""
        seen, out = self.project(q[None])[0], []
        for t in range(self.trees):
            far = np.zeros(1)
            for level in range(self.depth):
                m = seen[t, level] - self.cuts[t, 2**level - 1 : 2 ** (level + 1) - 1]
                far = (far[:, None] + (m * m)[:, None] * np.stack([m > 0, m <= 0], 1)).ravel()
            out.append(far)
        return np.concatenate(out)

    def share(self, sample: np.ndarray, k: int, target: float = TARGET) -> float:
        """The share of rows that holds ``target`` of the sample's own neighbours."""
        own, need = self.leaves(sample), []
        sizes = self.sizes.ravel()
        asked = np.linspace(0, len(sample) - 1, min(QUERIES, len(sample))).astype(int)
        for q in asked:
            cos = sample @ sample[q]
            cos[q] = -2
            near = np.argsort(-cos, kind="stable")[: min(k, len(sample) - 1)]
            order = np.argsort(self.distances(sample[q]), kind="stable")
            held = np.empty(len(order))
            held[order] = np.cumsum(sizes[order])
            need += held[own[near]].min(1).tolist()
        return float(np.quantile(need, target)) / self.rows if need else 1.0


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, which changes no digit, so that squares neither overflow nor
    vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, only finite numbers, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def distinct_vectors(rows: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(uid, members, v)``: each usable vector once, with its ``k + 1`` smallest ids. The
    bound is applied before the shuffle as well (a rank limit per task)."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    return own.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("members")).select(F.col("members")[0].alias("uid"), "members", "v")


def _first(group: np.ndarray, k: int) -> np.ndarray:
    """Which of the sorted rows are among the first ``k`` of their group."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k


def compare_leaf(raw: np.ndarray, members: pa.ListArray, qids: np.ndarray, asked: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(query, id, score)`` of the ``k`` nearest of each query among a leaf's vectors. All
    cosines come from products; what can be among the ``k + 1`` best, ties included, is scored
    again on the original vectors."""
    raw, asked = _scaled(raw), _scaled(asked)
    unit, norm = _unit(raw), np.sqrt(np.einsum("ij,ij->i", raw, raw))
    count, ids = members.value_lengths().to_numpy(), members.flatten().to_numpy()
    start = np.cumsum(count) - count
    step = max(1, PRODUCT // len(raw))
    n = min(len(raw), k + 1)
    for at in range(0, len(asked), step):
        q = asked[at : at + step]
        cos = _unit(q) @ unit.T
        i, j = np.nonzero(cos >= np.partition(cos, len(raw) - n, axis=1)[:, len(raw) - n, None] - 1e-9)
        score = np.empty(len(i))
        for a in range(0, len(i), 1 << 16):
            x, y = q[i[a : a + (1 << 16)]], raw[j[a : a + (1 << 16)]]
            score[a : a + (1 << 16)] = np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * norm[j[a : a + (1 << 16)]])
        many = count[j]
        one = ids[np.repeat(start[j], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        query, score = np.repeat(qids[at : at + step][i], many), np.repeat(score, many)
        own = query != one
        query, one, score = query[own], one[own], score[own]
        order = np.lexsort((one, -score, query))
        if len(order):
            order = order[_first(query[order], k)]
        yield query[order], one[order], score[order]


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, trees: int = TREES, share: float | None = None, leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's ``k`` nearest of the candidates
    found among ``rows``, itself left out."""
    spark = rows.sparkSession
    ship(spark)
    schema = "query_id long, vec_id long, score double"
    held = materialize(distinct_vectors(rows, k, id_col, vector_col), "ann-vectors")
    dims = held.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = dims[0]["d"], dims[0]["n"]
    held = held.where(F.size("v") == dim)
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // dim))
    # rows with the lowest hashes; the bound on them keeps the sort to little more than the sample
    spot = F.pmod(F.xxhash64("uid"), F.lit(1 << 30))
    low = spot <= F.lit(math.ceil(min(1.0, (1.2 * most + 200) / n) * (1 << 30)))
    sample = _unit(np.array([r["v"] for r in held.where(low).orderBy(spot, "uid").limit(most).select("v").collect()], dtype="f8"))
    forest = Forest(sample, n, trees, leaf)
    share = forest.share(sample, k) if share is None else share
    shared = spark.sparkContext.broadcast((forest, share))
    asked = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).alias("q")).where(F.col("qid").isNotNull() & usable(F.col("q")) & (F.size("q") == dim)).distinct()
    parts = max(1, math.ceil(n / 2**forest.depth / LEAF_PART))
    query_parts = max(1, math.ceil(asked.count() * min(1.0, share) / QUERY_PART))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, _ = shared.value
        for b in batches:
            if b.num_rows:
                own = forest.leaves(_unit(_matrix(b.column(2))))
                row = np.repeat(np.arange(b.num_rows), own.shape[1] * query_parts)
                part = (b.column(0).to_numpy().view("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype("i8") % parts
                key = pa.array((np.repeat(own.ravel(), query_parts) * parts + part[row]) * query_parts + np.tile(np.arange(query_parts), own.size))
                yield pa.RecordBatch.from_arrays([key, b.column(1).take(pa.array(row)), b.column(2).take(pa.array(row))], ["cell", "members", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, share = shared.value
        for b in batches:
            if b.num_rows:
                found = [np.array(forest.search(q, share), "i8") for q in _unit(_matrix(b.column(1)))]
                row = np.repeat(np.arange(b.num_rows), [len(f) * parts for f in found])
                part = (b.column(0).to_numpy().view("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype("i8") % query_parts
                key = (np.repeat(np.concatenate(found), parts) * parts + np.tile(np.arange(parts), sum(map(len, found)))) * query_parts + part[row]
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["cell", "qid", "q"])

    def compare(members: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if members.num_rows and asked.num_rows:
            found = list(compare_leaf(_matrix(members["v"]), members["members"].combine_chunks(), asked["qid"].to_numpy(), _matrix(asked["q"]), k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    kind = held.schema["v"].dataType.simpleString()
    index = held.mapInArrow(lean(place), f"cell long, members array<long>, v {kind}")
    probes = asked.mapInArrow(lean(probe), f"cell long, qid long, q {kind}")
    found = index.groupBy("cell").cogroup(probes.groupBy("cell")).applyInArrow(compare, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))
