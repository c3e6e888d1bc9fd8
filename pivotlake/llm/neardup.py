"""Near duplicates by a chosen-path similarity join, and the components of their links.

A document's set holds its distinct shingles. Every set gets a minwise signature of ``TREES``
x ``COORDINATES`` tokens; every tree has coordinates of its own. A tree branches documents by
coordinates that the path so far selects, the same for all documents of a node, so that two
documents go on together as long as the selected minwise tokens agree. Each node selects
``FANOUT`` = 2 coordinates: a pair of similarity 0.8 stays together in some node of any depth
with probability of at least 0.9375 (the root of p = 1 - (1 - 0.8 p)^2), and ``TREES`` = 4
independent trees miss it with probability 1.5e-5, were coordinates drawn anew at every node. They
are drawn from 32 a tree, some of them twice on a path: measured, a tree misses some 7 in 100
pairs, and four together 2.4e-5. Before full sets are compared, signatures
must agree in ``LEAST`` of 128 tokens, which misses another 5e-7. Links are confirmed on full
sets, always.

1. Exact copies of a set are one entity, of the smallest id.
2. Nodes of at most ``LEAF`` documents are compared exhaustively; larger ones branch again.
3. A large node whose sample looks alike holds a family of near copies. Its documents are
   compared with the family's core, the one that agrees most with the sample's commonest
   tokens; confirmed links contract the family. Nodes of one component are done. Nodes where
   few documents lie outside the main component compare these, as a stated query set in
   blocks, with all of the node; the others branch on, down to ``DEPTH``, where all that lie
   outside the main component are compared so.
4. In small nodes every document is confirmed against its closest partner of smaller id, and
   these links contract components.
5. What then shares a node, is close and lies in different components is confirmed inside the
   node, on full sets (a pair that meets in several small nodes of the first level in one of them
   only, so that few sets are sent twice), with the components found there: a node of m documents gives at most
   m - 1 links, however many of its documents are alike.

No links, components or fingerprints come to the driver, no pairs are emitted unconfirmed but
one per document and family or node, and tables between the steps are written to the shared
folder and deleted.

Defined results: null and empty texts have no set, size 0 and link with nothing; a text of
fewer words than a shingle is one shingle; rows of one id are one document, which links
through any of its texts; rows with null id link like others, but never name a component: a
component of such rows only is null; an empty table gives an empty table. Other columns are
not read, and pass through ``drop_near_duplicates``, which keeps one row of each component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import Scratch, lean, materialize, table, unwrap, wrap

TREES, FANOUT, DEPTH, LEAF = 4, 2, 8, 1024
#: Signature tokens of each tree, and how many of all must agree before full sets are
#: compared: a pair of similarity 0.8 agrees in fewer than 79 of 128 with probability 5e-7.
COORDINATES, LEAST = 32, 79
#: Documents of a block. Large nodes of two blocks at most, or with at most a block outside
#: their main component, branch no more.
BLOCK = 2048
#: Documents in a node's sample at most, and how many of them must agree with the sample's
#: commonest tokens as if linked, for the node to be a family. This steers work only.
SAMPLE, ALIKE = 32, 2
#: Nodes that hold more than this share of all rows are told apart by a broadcast list, which
#: therefore has fewer than ``HOT_NODES`` rows; others are dealt by their key.
HOT_NODES = 10_000
#: Rows up to which a table of one row a node is broadcast (measured; 600 bytes each at most).
BROADCAST_NODES = 20_000
#: Rows of two ids up to which a table is broadcast (measured; 16 bytes each), and links up to
#: which components are found in one task, instead of by rounds of joins.
BROADCAST_IDS, LOCAL_LINKS = 500_000, 1_000_000
#: Entities of null ids only are named from here on.
NAMELESS = 1 << 62

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers = {"up": np.ones(1, "u8"), "down": np.ones(1, "u8")}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        m = max(n, 1 << 17)
        for name, base in (("up", _R), ("down", _R_INVERSE)):
            _powers[name] = np.cumprod(np.concatenate([np.ones(1, "u8"), np.full(m - 1, base, "u8")]))
    return _powers["up"][:n], _powers["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | bytes | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles. Words are hashed as polynomials
    over their bytes, all at once, from running sums."""
    raw = np.frombuffer((text.encode() if isinstance(text, str) else text or b"").lower(), "u1")
    if not len(raw):
        return np.empty(0, "u8")
    space = _SPACE[raw]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype("i1"))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, "u8")
    up, down = _power(len(raw))
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum((raw.astype("u8") + np.uint64(1)) * up)])
    word = _mix((sums[end] - sums[start]) * down[start])
    n = min(size, len(word))
    out = np.full(len(word) - n + 1, n, "u8")
    for k in range(n):
        out = _mix(out * _R + word[k : len(word) - n + 1 + k])
    return np.unique(out)


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**32, TREES * COORDINATES, "u4") | np.uint32(1)


def minima(own: np.ndarray, a: np.ndarray) -> np.ndarray:
    """For every multiplier the smallest product with the set's hashes, 32 bits of them."""
    x, low = (own >> np.uint64(32)).astype("u4"), np.full(len(a), 2**32 - 1, "u4")
    room = np.empty((256, len(a)), "u4")
    for k in range(0, len(x), 256):
        part = x[k : k + 256, None]
        np.minimum(low, np.multiply(part, a, out=room[: len(part)]).min(0), out=low)
    return low


def fold(low: np.ndarray) -> np.ndarray:
    """Tokens of 16 bits from minima. The first branching takes whole minima, so that documents
    which have nothing in common do not meet, however many there are; deeper ones take tokens,
    and comparisons the tokens' low bytes."""
    return (_mix(low.astype("u8")) >> np.uint64(48)).astype("<u2")


def signature(own: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    return fold(minima(own, a))


@dataclass(frozen=True)
class Texts:
    """Documents as this module reads them: ids, texts, words in a shingle."""

    docs: DataFrame
    size: int
    nameless: bool = False

    def sketch(self) -> DataFrame:
        """``(doc_id, n, digest, brief, high, places)`` per row: low and high bytes of the tokens, and
        the nodes below the roots."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pivotlake.llm import neardup  # the worker's own module keeps tables of powers

            a = _multipliers()
            for batch in batches:
                n, digest, low = [], [], [np.empty((0, len(a)), "u4")]
                for t in batch.column(1).cast(pa.large_binary()):
                    own = neardup.shingle_set(t.as_py(), size)
                    n.append(len(own))
                    digest.append(_digest(own.tobytes()))
                    low.append(neardup.minima(own, a)[None])
                low = np.concatenate(low)
                sig = neardup.fold(low)
                brief, high = ([x.tobytes() for x in part.astype("u1")] for part in (sig, sig >> 8))
                places = np.hstack([neardup._children(np.full(len(low), r, "u8"), low) for r in range(TREES)]).view("i8")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(brief, pa.binary()), pa.array(high, pa.binary()), pa.array(list(places), pa.list_(pa.int64()))], ["doc_id", "n", "digest", "brief", "high", "places"])

        return self.docs.mapInArrow(lean(run), "doc_id long, n long, digest binary, brief binary, high binary, places array<long>")

    def sets(self, ids: DataFrame) -> DataFrame:
        """``(id, set, brief)`` for the entities among the stored ``ids``; only their texts become
        sets again. Rows of one id with different texts give a row each. Entities without
        an id are found by their set's digest."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pivotlake.llm import neardup

            a = _multipliers()
            for b in batches:
                sets = [neardup.shingle_set(t.as_py(), size) for t in b.column(1).cast(pa.large_binary())]
                raw = [x.tobytes() for x in sets]
                brief = [neardup.signature(x, a).astype("u1").tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(brief, pa.binary()), pa.array([_digest(x) for x in raw], pa.binary())], ["id", "set", "brief", "digest"])

        made = lambda rows: rows.mapInArrow(lean(run), "id long, set binary, brief binary, digest binary").where(F.length("set") > 0)
        out = made(self.docs.join(_light(ids).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")).select("id", "set", "brief")
        if self.nameless:
            own = made(self.docs.where("doc_id is null")).select(_nameless(F.col("digest")).alias("id"), "set", "brief")
            out = out.union(own.join(ids, "id", "left_semi").dropDuplicates(["id"]))
        return out


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _nameless(digest: Column) -> Column:
    """The name of an entity without ids, from its digest."""
    return F.xxhash64(digest).bitwiseAND(F.lit(NAMELESS - 1)).bitwiseOR(F.lit(NAMELESS))


def _signatures(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length binary values as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), "u1").reshape(len(column), -1)


def _children(node: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """The nodes that each row goes to: one per selected coordinate of the node's tree (its
    two lowest bits), which the node alone decides; a child is named by its parent, the
    coordinate and the row's token there."""
    g, t, tree = _mix(node * _R + np.uint64(1)), np.uint64(COORDINATES), node & np.uint64(TREES - 1)
    first = g % t
    out = []
    for k in range(FANOUT):
        j = (first + np.uint64(k) * (np.uint64(1) + (g >> np.uint64(32)) % (t - np.uint64(1)))) % t
        token = np.take_along_axis(sig, (tree * t + j)[:, None].astype("i8"), 1)[:, 0].astype("u8")
        child = _mix(_mix(node + j * _R) ^ (token * _R))
        out.append((child & ~np.uint64(TREES - 1)) | tree)
    return np.stack(out, 1)


def _branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, id, brief, high)`` to the children's ``(node, id)``."""
    for b in batches:
        if b.num_rows:
            sig = _signatures(b.column(2)).astype("u2") | _signatures(b.column(3)).astype("u2") << 8
            child = _children(b.column(0).to_numpy().view("u8"), sig)
            ids = np.repeat(b.column(1).to_numpy(), child.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(child.ravel().view("i8")), pa.array(ids)], ["node", "id"])


def _of_node(rows: DataFrame, info: DataFrame, broadcast_rows: int = BROADCAST_NODES) -> DataFrame:
    """``rows`` with what a stored table says of their nodes; it is broadcast if it is small,
    so that no large node meets in a task."""
    return rows.join(F.broadcast(info) if info.count() <= broadcast_rows else info, "node")


def split_nodes(rows: DataFrame, keep: Scratch) -> tuple[DataFrame, DataFrame]:
    """The stored ``(node, id)`` rows of small and of large nodes; documents alone in a node
    go. Nodes with more than a ``HOT_NODES``-th of the rows are not dealt by their key."""
    counts = keep(rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "counts")
    most = max(LEAF, rows.count() // HOT_NODES)
    hot = F.broadcast(counts.where(F.col("size") > most))
    rest = rows.join(hot.select("node"), "node", "left_anti").join(counts.where(F.col("size") <= most), "node")
    shared = keep(rows.join(hot, "node").unionByName(rest), "shared")
    keep.drop(rows, counts)
    return tuple(shared.where(which).select("node", "id") for which in (F.col("size") <= LEAF, F.col("size") > LEAF))


def _commonest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, briefs)`` to ``(node, mode)``, the commonest token of every coordinate, where
    the sample looks like a family."""
    for b in batches:
        nodes, modes = [], []
        for node, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            sig = np.frombuffer(b"".join(own.as_py()), "u1").reshape(-1, TREES * COORDINATES)
            x = np.sort(sig, axis=0)
            runs, best = np.ones(x.shape[1], "i4"), np.ones(x.shape[1], "i4")
            mode = x[0].copy()
            for k in range(1, len(x)):
                runs = np.where(x[k] == x[k - 1], runs + 1, 1)
                mode = np.where(runs > best, x[k], mode)
                best = np.maximum(best, runs)
            if ((sig == mode).sum(1) >= LEAST).sum() >= ALIKE:
                nodes.append(node)
                modes.append(mode.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(modes, pa.binary())], ["node", "mode"])


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(x, y, brief, other)`` to ``(x, y, agree)``, agree the number of equal tokens."""
    for b in batches:
        if b.num_rows:
            agree = (_signatures(b.column(2)) == _signatures(b.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(agree, pa.int64())], ["x", "y", "agree"])


def core_pairs(large: DataFrame, sigs: DataFrame, keep: Scratch) -> DataFrame | None:
    """The stored ``(a, b)``: every document of a family with the family's core, if their
    signatures agree enough; None where no node is a family."""
    pick = large.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("slot")).agg(F.min(F.struct(F.xxhash64("id", "node").alias("h"), "id")).alias("r"))
    sample = pick.select("node", F.col("r.id").alias("id")).join(sigs, "id").groupBy("node").agg(F.collect_list("brief").alias("briefs"))
    modes = keep(sample.mapInArrow(lean(_commonest), "node long, mode binary"), "modes")
    if modes.isEmpty():
        return None
    seen = keep(_of_node(large, modes).select("node", "id").join(sigs.select("id", "brief"), "id"), "family")
    like = _of_node(seen, modes).select("node", "id", "brief", "mode").mapInArrow(lean(_agreement), "x long, y long, agree long")
    best = like.groupBy(F.col("x").alias("node")).agg(F.max(F.struct("agree", (-F.col("y")).alias("minus"))).alias("r")).select("node", (-F.col("r.minus")).alias("core"))
    cores = keep(best.join(sigs.select(F.col("id").alias("core"), F.col("brief").alias("other")), "core"), "cores")
    both = _of_node(seen, cores).where("id <> core").select("id", "core", "brief", "other")
    close = both.mapInArrow(lean(_agreement), "x long, y long, agree long").where(F.col("agree") >= LEAST)
    return keep(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "core-pairs")


def grow_trees(texts: Texts, entities: DataFrame, keep: Scratch) -> tuple[list[DataFrame], list[DataFrame], DataFrame | None]:
    """``(node, id)`` of small nodes, a table a level; ``(node, id, size, n_out, main)`` of large ones that are
    to be compared in blocks; and ``(child, root)`` of the links to cores. One level a turn:
    count nodes, keep shared ones, contract families, branch the large ones again."""
    sigs = entities.select("id", "brief", "high")
    rows = entities.select(F.explode("places").alias("node"), "id")
    small, parted, roots = [], [], None
    for depth in range(1, DEPTH + 1):
        few, large = split_nodes(keep(rows, f"nodes-{depth}"), keep)
        small.append(few)
        if large.isEmpty():
            break
        sigs = keep(sigs.join(_light(keep(large.select("id").distinct(), "ids")), "id", "left_semi"), "large-sigs")
        pairs = core_pairs(large, sigs, keep)
        if pairs is not None:
            roots = merge(roots, confirm_links(pairs, texts, keep), keep)
            keep.drop(pairs)
        own = keep(relabel(large.withColumn("comp", F.col("id")), "comp", roots), "large")
        parts = own.groupBy("node", "comp").agg(F.count("*").alias("n")).groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("m"))
        parts = keep(parts.select("node", "size", (F.col("size") - F.col("m.n")).alias("n_out"), F.col("m.comp").alias("main")).where("n_out > 0"), "parts")
        own = _of_node(own.select("node", "id"), parts)
        done = F.lit(depth == DEPTH) | (F.col("n_out") <= BLOCK) | (F.col("size") <= 2 * BLOCK)
        parted.append(own.where(done))
        if parts.where(~done).isEmpty():
            break
        rows = own.where(~done).join(sigs, "id").select("node", "id", "brief", "high").mapInArrow(lean(_branch), "node long, id long")
    return small, parted, roots


def _light(rows: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it is small."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches, cut so that no group of the first ``keys`` columns is parted."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in range(keys):
            c = b.column(k).to_numpy()
            last = held[-1].column(k)[-1].as_py() if held else c[0]
            change |= np.concatenate([[c[0] != last], c[1:] != c[:-1]])
        at = np.flatnonzero(change)
        if len(at):
            if held or at[-1]:
                yield pa.Table.from_batches([*held, b.slice(0, at[-1])])
            held = [b.slice(at[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _close(node: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers (i, j), i before j in one node, whose signatures agree enough, and their
    agreement. All distances inside a node are gone through, vectorised over all nodes."""
    i = np.arange(len(node) - 1)
    for gap in range(1, len(node)):
        i = i[i + gap < len(node)]
        i = i[node[i] == node[i + gap]]
        if not len(i):
            return
        agree = (sig[i] == sig[i + gap]).sum(1)
        ok = agree >= LEAST
        if ok.any():
            yield i[ok], i[ok] + gap, agree[ok]


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(node, id, brief, comp)``, sorted, to ``(id, partner, agree)``: each row that has any
    close partner in another component, with its closest one of smaller id, if any."""
    for t in _by_key(batches, 1):
        ids, comp = t["id"].to_numpy(), t["comp"].to_numpy()
        best, partner, close = np.zeros(len(ids), "i8"), np.full(len(ids), -1, "i8"), np.zeros(len(ids), bool)
        for i, j, agree in _close(t["node"].to_numpy(), _signatures(t["brief"])):
            other = comp[i] != comp[j]
            i, j, agree = i[other], j[other], agree[other]
            close[i] = close[j] = True
            better = agree > best[j]
            best[j[better]], partner[j[better]] = agree[better], i[better]
        own = np.flatnonzero(close)
        some = partner[own] >= 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[partner[own]], mask=~some), pa.array(best[own])], ["id", "partner", "agree"])


#: A cell is a small node, or a block of a large one with a block of those that ask in it.
CELL = "node long, asked_block long, block long, id long, asks boolean"


def _pairs_of_cell(sig: np.ndarray, comp: np.ndarray, asks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every asking row of a cell, the close rows of other components, and the agreement.
    Pairs of rows that both ask come once."""
    for q in np.flatnonzero(asks):
        rest = np.flatnonzero((comp != comp[q]) & (~asks | (np.arange(len(asks)) > q)))
        agree = (sig[rest] == sig[q]).sum(1)
        ok = agree >= LEAST
        if ok.any():
            yield q, rest[ok], agree[ok]


def _cells(t: pa.Table) -> list[np.ndarray]:
    cut = np.flatnonzero(np.any([np.diff(t.column(k).to_numpy()) != 0 for k in range(3)], axis=0)) + 1
    return np.split(np.arange(t.num_rows), cut)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, nodes)`` to ``(id, firsts)``: nodes side by side, filled up with zeros. An id with
    several sets lies in more nodes; its pairs belong to every cell."""
    width = TREES * FANOUT
    for b in batches:
        own = [np.array([*v, *[0] * (width - len(v))] if len(v) <= width else [0] * width, "<i8").tobytes() for v in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.binary())], ["id", "firsts"])


def _own_pairs(node: int, firsts: np.ndarray, q: int, near: np.ndarray) -> np.ndarray:
    """Which of the rows ``near`` meet row ``q`` here first. ``firsts`` holds every row's small nodes
    of the first level, filled up with zeros. A pair that shares any belongs to the smallest, so
    to one cell; a pair that shares none belongs to every cell where it meets."""
    mine = firsts[q][firsts[q] != 0]
    shared = np.where(np.isin(firsts[near], mine), firsts[near], np.iinfo("i8").max).min(1)
    return near[(shared == node) | (shared == np.iinfo("i8").max)]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CELL`` with ``brief``, ``comp`` and ``firsts``, sorted, to the ``CELL`` rows that take part in
    any close pair of different components that belongs to the cell. No pair leaves the cell."""
    for t in _by_key(batches, 3):
        sig, comp, asks, node = _signatures(t["brief"]), t["comp"].to_numpy(), t["asks"].to_numpy(), t["node"].to_numpy()
        firsts = np.frombuffer(b"".join(t["firsts"].to_pylist()), "<i8").reshape(t.num_rows, -1)
        marked = np.zeros(t.num_rows, bool)
        for own in _cells(t):
            if (comp[own] != comp[own[0]]).any():
                for q, near, _ in _pairs_of_cell(sig[own], comp[own], asks[own]):
                    near = _own_pairs(node[own[0]], firsts[own], q, near)
                    if len(near):
                        marked[own[q]] = marked[own[near]] = True
        yield from t.filter(pa.array(marked)).select(["node", "asked_block", "block", "id", "asks"]).to_batches()


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 x intersection >= 80 x union, for sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(x) < 80 * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= 80 * (len(x) + len(y) - both)


class CellSets:
    """The sets of one cell, their elements numbered, so that one set is compared with many
    at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(x) for x in sets])
        self.end = np.cumsum(self.size)
        elements, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.own = np.zeros(len(elements), bool)

    def similar(self, q: int, rows: np.ndarray) -> np.ndarray:
        """Whether 100 x intersection >= 80 x union, for set q with each of ``rows``."""
        rows = rows[(100 * self.size[rows] >= 80 * self.size[q]) & (100 * self.size[q] >= 80 * self.size[rows])]
        if not len(rows):
            return rows
        mine = self.codes[self.end[q] - self.size[q] : self.end[q]]
        self.own[mine] = True
        size = self.size[rows]
        at = np.repeat(self.end[rows] - np.cumsum(size), size) + np.arange(size.sum())
        both = np.add.reduceat(self.own[self.codes[at]].astype("i8"), np.cumsum(size) - size)
        self.own[mine] = False
        return rows[100 * both >= 80 * (size + len(mine) - both)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``CELL`` with ``brief``, ``comp`` and ``set``, sorted, to confirmed links ``(a, b)`` that
    join components: one per pair of components at most, and rows whose components a link of
    the cell has joined already are passed over; so links are fewer than rows."""
    for t in _by_key(batches, 3):
        ids, sig, comp, asks = t["id"].to_numpy(), _signatures(t["brief"]), t["comp"].to_numpy(), t["asks"].to_numpy()
        sets, a, b = t["set"].combine_chunks(), [], []
        for own in _cells(t):
            cell, root = None, {c: c for c in comp[own].tolist()}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for q, near, _ in _pairs_of_cell(sig[own], comp[own], asks[own]):
                mine = find(int(comp[own[q]]))
                near = near[[find(c) != mine for c in comp[own[near]].tolist()]]
                if not len(near):
                    continue
                cell = cell or CellSets([np.frombuffer(sets[int(k)].as_buffer(), "<u8") for k in own])
                for k in cell.similar(q, near).tolist():
                    x, y = find(int(comp[own[q]])), find(int(comp[own[k]]))
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        a.append(ids[own[q]])
                        b.append(ids[own[k]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, set_a, set_b)`` to the pairs with 100 x intersection >= 80 x union."""
    for batch in batches:
        keep = [similar(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays(kept.columns, ["a", "b"])


def confirm_links(pairs: DataFrame, texts: Texts, keep: Scratch) -> DataFrame:
    """The stored ``(a, b)`` whose full sets are similar enough. Few pairs go to the sets of one
    end, so that only those of the other are dealt anew."""
    if pairs.isEmpty():
        return pairs
    ids = keep(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = keep(texts.sets(ids).select("id", "set"), "sets")
    both = sets.toDF("a", "set_a").join(_light(pairs.select("a", "b")), "a").join(sets.toDF("b", "set_b"), "b")
    links = keep(both.select("a", "b", "set_a", "set_b").mapInArrow(lean(_confirm), "a long, b long"), "links")
    keep.drop(ids, sets)
    return links


def compress(forest: DataFrame, keep: Scratch) -> DataFrame:
    """``(child, parent)``, parents smaller than children, to ``(child, root)`` by pointer
    jumping: the number of turns is the logarithm of the depth."""
    at = keep(forest.select("child", "parent"), "forest")
    while True:
        up = at.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        at = keep(at.join(up, "parent", "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "forest")
        if at.where("moved").isEmpty():
            return at.select("child", F.col("parent").alias("root"))


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` to ``(child, root)``."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for t in batches:
        for a, b in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = [(x, y) for x in list(root) if (y := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["child", "root"])


def contract(edges: DataFrame, keep: Scratch, local: int | None = None) -> DataFrame | None:
    """``(child, root)``, stored, for the components of any graph; None where there is no
    edge. Few links (counted) are joined in one task. For more, every end hooks to its
    smallest smaller neighbour, hooks are compressed, edges are renamed, until none is left."""
    tidy = lambda e: keep(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b"), "edges")
    edges, total = tidy(edges), None
    n = edges.count()
    if n and n <= (LOCAL_LINKS if local is None else local):
        return keep(edges.coalesce(1).mapInArrow(lean(_union_find), "child long, root long"), "roots")
    while not edges.isEmpty():
        roots = compress(edges.groupBy(F.col("b").alias("child")).agg(F.min("a").alias("parent")), keep)
        total = roots if total is None else keep(relabel(total, "root", roots).union(roots), "roots")
        edges = tidy(relabel(relabel(edges, "a", roots), "b", roots).distinct())
    return total


def relabel(rows: DataFrame, column: str, roots: DataFrame | None) -> DataFrame:
    """``rows`` with ``column`` replaced by its root, where the stored ``roots`` have one."""
    if roots is None:
        return rows
    r = _light(roots).toDF("_child", "_root")
    return rows.join(r, F.col(column) == F.col("_child"), "left").withColumn(column, F.coalesce("_root", column)).drop("_child", "_root")


def merge(roots: DataFrame | None, edges: DataFrame, keep: Scratch) -> DataFrame | None:
    """``(child, root)`` after more links."""
    new = contract(relabel(relabel(edges, "a", roots), "b", roots), keep)
    if roots is None or new is None:
        return roots if new is None else new
    return keep(relabel(roots, "root", new).union(new), "roots")


def dealt_cells(parted: DataFrame, known: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Large nodes as ``CELL`` rows: the documents outside the main component ask; blocks of
    them meet blocks of the whole node."""
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    spot = F.xxhash64("id")
    own = relabel(parted.join(known, "id"), "main", roots)
    rows = own.select("node", "id", (F.col("comp") != F.col("main")).alias("asks"), blocks(F.col("n_out")).alias("n_asked"), blocks(F.col("size")).alias("n_all"))
    asking = rows.where("asks").withColumn("asked_block", F.pmod(spot, F.col("n_asked"))).withColumn("block", every("n_all"))
    rest = rows.withColumn("asks", F.lit(False)).withColumn("block", F.pmod(spot, F.col("n_all"))).withColumn("asked_block", every("n_asked"))
    return asking.unionByName(rest).select("node", "asked_block", "block", "id", "asks")


def cluster(docs: DataFrame, size: int, text_col: str, id_col: str, keep: Scratch) -> DataFrame:
    """``(doc_id, n, digest, comp)`` per row of ``docs``: ``comp`` is the component's smallest
    id, or a name from ``NAMELESS`` on, or null where there is no set."""
    ship(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = keep(Texts(docs, size).sketch(), "sketches")
    same = ("brief", "high", "places")  # of one digest
    firsts = rows.where(F.col("n") > 0).groupBy("digest").agg(F.min("doc_id").alias("id"), *[F.min(c).alias(c) for c in same])
    entities = keep(firsts.select("digest", F.coalesce("id", _nameless(F.col("digest"))).alias("id"), *same), "entities")
    texts = Texts(docs, size, not entities.where(F.col("id") >= NAMELESS).isEmpty())
    names = keep(rows.select("doc_id", "n", "digest").join(entities.select("digest", "id"), "digest", "left"), "names")
    keep.drop(rows)
    levels, parted, roots = grow_trees(texts, entities, keep)
    small = reduce(DataFrame.union, levels)
    # components are told to entities, not to their many places in nodes
    known = lambda roots: relabel(entities.select("id", "brief", F.col("id").alias("comp")), "comp", roots)

    # the closest partner of smaller id in small nodes
    within = small.join(known(roots), "id").select("node", "id", "brief", "comp")
    near = within.repartition("node").sortWithinPartitions("node", "id").mapInArrow(lean(_partners), "id long, partner long, agree long")
    best = F.max(F.when(F.col("partner").isNotNull(), F.struct("agree", (-F.col("partner")).alias("minus"))))
    chosen = keep(near.groupBy("id").agg(best.alias("best")).select("id", (-F.col("best.minus")).alias("partner")), "partners")
    pairs = keep(chosen.where("partner is not null and partner <> id").select(F.col("partner").alias("a"), F.col("id").alias("b")), "partner-pairs")
    roots = merge(roots, confirm_links(pairs, texts, keep), keep)

    # what is left of close documents in different components is confirmed inside the cells
    zero = F.lit(0).cast("long")
    cells = small.join(chosen, "id", "left_semi").select("node", zero.alias("asked_block"), zero.alias("block"), "id", F.lit(True).alias("asks"))
    for p in parted:
        cells = cells.union(dealt_cells(p, known(roots).select("id", "comp"), roots))
    key = ("node", "asked_block", "block")
    # close pairs meet in several nodes of the first level: they are confirmed in one of them
    width = TREES * FANOUT
    firsts = levels[0].join(chosen.select("id"), "id", "left_semi").groupBy("id").agg(F.collect_set("node").alias("f")).mapInArrow(lean(_packed), "id long, firsts binary")
    close = cells.join(known(roots), "id").join(firsts, "id", "left").select(*key, "id", "asks", "brief", "comp", F.coalesce("firsts", F.lit(bytes(8 * width))).alias("firsts"))
    marks = keep(close.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(lean(_marks), CELL), "marks")
    # rows of one id with several sets are one document
    several = names.where("doc_id is not null and id is not null").select("doc_id", "id").distinct()
    firsts = several.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z")
    links = several.join(firsts, "doc_id").select("a", F.col("id").alias("b"))
    if not marks.isEmpty():
        sets = keep(texts.sets(keep(marks.select("id").distinct(), "ids")), "sets")
        told = relabel(sets.withColumn("comp", F.col("id")), "comp", roots)
        own = told.join(_light(marks), "id").select(*key, "id", "asks", "brief", "comp", "set")
        links = links.union(own.repartition(*key).sortWithinPartitions(*key, "id").mapInArrow(lean(_links), "a long, b long"))
    roots = merge(roots, links, keep)
    return relabel(names.withColumn("comp", F.col("id")), "comp", roots).select("doc_id", "n", "digest", "comp")


def near_duplicates(docs: DataFrame, size: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs``."""
    with Scratch() as keep:
        found = cluster(docs, size, text_col, id_col, keep)
        component = F.when(F.col("comp").isNull(), F.col("doc_id")).when(F.col("comp") < NAMELESS, F.col("comp"))
        out = found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
        return materialize(out, "components")


def drop_near_duplicates(docs: DataFrame, size: int = 5, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component. Shingles have five
    words; two are the contract of op2 only, and link documents that merely share phrases.
    Of rows that repeat an id one stays, and of components of null ids only one row. Texts
    without a word link with nothing, so all such rows of different ids, or of none, stay."""
    with Scratch() as keep:
        found = keep(cluster(docs, size, text_col, id_col, keep), "found")
        stays = F.max(F.col("comp").isNull() | (F.col("doc_id") == F.col("comp")))
        ids = keep(found.where("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays"), F.count("*").alias("c")), "ids")
        gone = materialize(ids.where("not stays").select("doc_id"), "gone-ids")
        nulls = not found.where("doc_id is null").isEmpty()
        again = not ids.where("stays and c > 1").isEmpty()
        lone = materialize(found.where("doc_id is null and comp >= " + str(NAMELESS)).groupBy("comp").agg(F.min("digest").alias("digest")).select("digest"), "kept-digests") if nulls else None
        twice = materialize(ids.where("stays and c > 1").select("doc_id"), "twice-ids") if again else None
    among = lambda rows, few, how: rows.alias("l").join(_light(few).alias("r"), F.col(f"l.`{id_col}`").cast("long") == F.col("r.doc_id"), how)
    # the ids that go are the fewer ones: while they can be broadcast, no text is shuffled
    kept = among(docs.where(docs[f"`{id_col}`"].isNotNull()), gone, "left_anti")
    if again:
        kept = among(kept, twice, "left_anti").union(among(kept, twice, "left_semi").dropDuplicates([id_col]))
    if nulls:
        kept = kept.union(_nameless_rows(docs.where(docs[f"`{id_col}`"].isNull()), lone, size, text_col))
    return kept


def _nameless_rows(rows: DataFrame, lone: DataFrame, size: int, text_col: str) -> DataFrame:
    """Of rows without ids those without a set, and one of each digest in ``lone``."""

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        from pivotlake.llm import neardup

        sets = [neardup.shingle_set(t.as_py(), size).tobytes() for t in texts.cast(pa.large_binary())]
        return pa.array([neardup._digest(x) if x else None for x in sets], pa.binary())

    own = wrap(rows, digest=digest(F.col(text_col)))
    first = own.join(lone.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left_semi").dropDuplicates(["digest"])
    return unwrap(own.where("digest is null").union(first))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


ORACLE = r"""
with recursive d as materialized (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select k, doc_id, list_distinct(case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d),
u as materialized (select k, len(s) as n, unnest(s) as g from s),
p as (select a.k as a, b.k as b, a.n as na, b.n as nb, count(*) as m from u a join u b on a.g = b.g and a.k < b.k and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by all),
l as materialized (select x.doc_id as x, y.doc_id as y from p join d x on x.k = p.a join d y on y.k = p.b where 100 * m >= 80 * (na + nb - m)),
e as materialized (select x, y from l union select y, x from l),
r(x, c) as (select distinct doc_id, doc_id from d where doc_id is not null union select e.x, r.c from r join e on e.y = r.x),
c as (select x, min(c) as c from r group by x)
select doc_id, len(s)::BIGINT as n_shingles, c as component_id, doc_id is not distinct from c as kept from s left join c on c.x = doc_id
"""
