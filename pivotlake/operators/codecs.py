"""Compressed index buckets: one chain of values per pivot, stored in segments of objects.

Input is ``(ref_id, obj_id, pos)``; ids may have holes. A chain is coded without a break, but in
rows of at most ``SEGMENT`` objects, so that a row is a bounded group and all of them are coded
at once. Every row can be read alone: it tells the cell before its first value (``base``) and,
where they do not simply count up from ``first``, the ids of its objects.

Gap form: the first cell of a chain, then differences of consecutive cells
``obj_id * n + pos``, all at least 1. Position form: the positions themselves. Delta codes
start at 1, so the position form and a first gap are biased by one. Bits are laid out from
the low end of each byte, and a row takes bits / 8 + 1 bytes. ``marks`` tells of every
``EVERY``-th value where its code begins and which cell it counts from, so a look-up decodes
one block.

A Simple-9 word takes as many of the next values as fit, so where the words of a segment begin
depends on all segments before it. A segment is entered at one of 28 offsets; for each it is
computed how many words begin in it and at which offset the next segment is entered. These maps
compose along the chain, in blocks; then every segment knows its offset and makes its words,
looking at the 27 values that follow it. A first cell counts from its object's first cell, and a
gap of 28 bits or more (a hole in the ids) is coded as if ids were consecutive, which leaves the
position, its remainder by n, as it is; rows with such a gap store their ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pivotlake.functions import codes
from pivotlake.functions.shipping import ship

SEGMENT = 1 << 16
#: Ids of a run of whole arrays.
RUN = 1 << 13
#: Values between two marks of a delta row.
EVERY = 64
#: Offsets at which a segment can be entered by a Simple-9 word, and segments of a block of maps.
S9_OFFSETS, S9_BLOCK = 28, 1024
_S9_SCHEMA = pa.schema([("ref_id", pa.int64()), ("seg", pa.int64()), ("first", pa.int64()), ("nvals", pa.int64()), ("base", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.field("element", pa.int32())))])


def _segment(segment: int | None) -> F.Column:
    return F.floor(F.col("obj_id") / F.lit(segment)).cast("long") if segment else F.lit(0).cast("long")


def _in_place(rows: DataFrame) -> DataFrame:
    """For a join of a chain's rows with few rows that were dealt by pivot. Small estimates can make Spark
    broadcast the many rows and join them where the few lie, whole chains in a task; sorted, they stay dealt
    by all keys of the join."""
    return rows.hint("merge")


def gap_values(positions: DataFrame, n: int, segment: int | None = None, state: DataFrame | None = None) -> DataFrame:
    """``(ref_id, obj_id, seg, gap, first, last)``; ``last`` is the cell before, 0 at first. Chains
    go on from ``state``, ``(ref_id, cell)``, if it is given. The cell before is found by a window inside runs
    of ``SEGMENT`` objects, so no task holds a whole chain; where chains are unbroken, a run's
    first cell looks up the last one of the run before, one row a run."""
    run = F.floor(F.col("obj_id") / F.lit(segment or SEGMENT)).cast("long").alias("run")
    own = positions.select("ref_id", "obj_id", run, codes.pack_cell(F.col("obj_id"), F.col("pos"), n).alias("cell"))
    own = own.repartition("ref_id", "run")  # dealt once, for the windows and for the runs' last cells
    inside = Window.partitionBy("ref_id", "run").orderBy("obj_id")
    lagged = own.withColumn("last", F.lag("cell").over(inside))
    if segment is None:
        runs = own.groupBy("ref_id", "run").agg(F.max("cell").alias("end"))
        # a run without cells is passed over: the one before is the last that has any
        ends = runs.select("ref_id", "run", F.lag("end").over(Window.partitionBy("ref_id").orderBy("run")).alias("before"))
        lagged = _in_place(lagged).join(ends, ["ref_id", "run"]).withColumn("last", F.coalesce("last", "before"))
    if state is not None:
        lagged = lagged.join(state.select("ref_id", F.col("cell").alias("known")), "ref_id", "left").withColumn("last", F.coalesce("last", "known"))
    seg = F.col("run") if segment else F.lit(0).cast("long")
    return lagged.select("ref_id", "obj_id", seg.alias("seg"), (F.col("cell") - F.coalesce("last", F.lit(0))).alias("gap"), F.col("last").isNull().alias("first"), F.coalesce("last", F.lit(0)).alias("last"))


def restore_gaps(gaps: DataFrame, n: int, segment: int = SEGMENT) -> DataFrame:
    """``(ref_id, obj_id, pos)`` from unbroken gaps: running sums inside segments, and sums
    of segments before, so no window holds a whole chain. 64-bit throughout."""
    cut = gaps.select("ref_id", "obj_id", "gap", _segment(segment).alias("s"))
    before = Window.partitionBy("ref_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("ref_id", "s").agg(F.sum("gap").alias("t")).select("ref_id", "s", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("ref_id", "s").orderBy("obj_id").rowsBetween(Window.unboundedPreceding, 0)
    return _in_place(cut.withColumn("run", F.sum("gap").over(inside))).join(starts, ["ref_id", "s"]).select("ref_id", "obj_id", codes.cell_position(F.col("start") + F.col("run"), n).alias("pos"))


def coded_values(positions: DataFrame, n: int, form: str, bias: bool, segment: int | None = None) -> DataFrame:
    """``(ref_id, seg, obj_id, value)``: what a coder writes."""
    if form == "pos":
        return positions.select("ref_id", _segment(segment).alias("seg"), "obj_id", (F.col("pos") + int(bias)).cast("long").alias("value"))
    extra = F.when(F.col("first"), 1).otherwise(0) if bias else F.lit(0)
    return gap_values(positions, n, segment).select("ref_id", "seg", "obj_id", (F.col("gap") + extra).alias("value"))


def delta_sizes(positions: DataFrame, n: int, form: str) -> DataFrame:
    """``(ref_id, bits)`` per bucket, and the total under a null ``ref_id``."""
    values = coded_values(positions, n, form, True)
    return _with_total(values.groupBy("ref_id").agg(F.sum(codes.delta_length(F.col("value"))).alias("bits")))


def _with_total(sizes: DataFrame) -> DataFrame:
    """``(ref_id, size)`` and the sum under a null ``ref_id``, which is there, and null, where
    there are no rows."""
    _, size = sizes.columns
    return sizes.union(sizes.agg(F.sum(size).alias(size)).select(F.lit(None).cast("long"), size))


def delta_sizes_of(index: DataFrame, n: int, form: str) -> DataFrame:
    """The same from an index ``(obj_id, pos)`` of position arrays. Gaps are taken between
    neighbouring objects inside runs of ``RUN`` ids, so arrays are shuffled and not cells;
    only the first and last object of a run meet those of other runs, one row a run and pivot."""
    if form == "pos":
        cells = index.select(F.posexplode("pos").alias("ref_id", "pos"))
        bits = cells.select("ref_id", codes.delta_length(F.col("pos") + 1).alias("bits"))
    else:
        own = index.select("obj_id", "pos", F.floor(F.col("obj_id") / RUN).cast("long").alias("run")).repartition("run")
        before = F.lag(F.struct("obj_id", "pos")).over(Window.partitionBy("run").orderBy("obj_id"))
        inner = own.withColumn("b", before).where(F.col("b").isNotNull()).select(F.col("obj_id") - F.col("b.obj_id"), F.posexplode(F.arrays_zip("pos", F.col("b.pos").alias("was")))).toDF("step", "ref_id", "x")
        inner = inner.select("ref_id", codes.delta_length(F.col("step") * n + F.col("x.pos") - F.col("x.was")).alias("bits"))
        row = F.struct("obj_id", "pos")
        ends = own.groupBy("run").agg(F.min_by(row, "obj_id").alias("one"), F.max_by(row, "obj_id").alias("two"))
        ends = ends.select("run", "one.obj_id", F.col("two.obj_id").alias("end_id"), F.posexplode(F.arrays_zip(F.col("one.pos").alias("pos"), F.col("two.pos").alias("end_pos"))).alias("ref_id", "x"))
        cells = ends.select("ref_id", "run", codes.pack_cell(F.col("obj_id"), F.col("x.pos"), n).alias("cell"), codes.pack_cell(F.col("end_id"), F.col("x.end_pos"), n).alias("end"))
        known = F.lag("end").over(Window.partitionBy("ref_id").orderBy("run"))
        bits = inner.union(cells.withColumn("last", known).select("ref_id", codes.delta_length(F.col("cell") - F.coalesce("last", F.lit(-1))).alias("bits")))
    return bits.select(F.col("ref_id").cast("long").alias("ref_id"), "bits").groupBy("ref_id").agg(F.sum("bits").alias("bits")).transform(_with_total)


_POWERS = 2 ** np.arange(63, dtype="i8")


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value; 0 has none."""
    return np.searchsorted(_POWERS, values, side="right")


def delta_widths(values: np.ndarray) -> np.ndarray:
    """Bits of the delta code of each value."""
    size = _widths(values)
    return 2 * _widths(size) - 1 + size - 1


def delta_pack(values: np.ndarray) -> tuple[int, bytes]:
    """Number of bits and the bytes of the delta codes of ``values`` (each at least 1)."""
    if len(values) and values.min() < 1:
        raise ValueError("delta codes start at 1")
    values = values.astype("i8")
    size = _widths(values)
    head = _widths(size)
    # two fields a value: its bit length behind zeros, then its low bits
    field = np.stack([size, values & ((1 << np.maximum(size - 1, 0)) - 1)], 1).ravel()
    width = np.stack([2 * head - 1, size - 1], 1).ravel()
    total = int(width.sum())
    shift = np.repeat(width, width) - 1 - (np.arange(total) - np.repeat(np.cumsum(width) - width, width))
    bits = (np.repeat(field, width) >> shift) & 1
    return total, np.packbits(bits.astype("u1"), bitorder="little").tobytes().ljust(total // 8 + 1, b"\0")


def _fields(bits: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers that stand at ``start`` in so many bits, highest first."""
    out = np.zeros(len(start), "i8")
    for k in range(int(width.max(initial=0))):
        more = width > k
        out[more] = out[more] << 1 | bits[start[more] + k]
    return out


def delta_unpack(code: bytes, n_values: int) -> np.ndarray:
    """The first ``n_values`` values. For every place of the code it is found where a code that
    begins there would end; the values' places follow from the first, and all are read at once."""
    bits = np.unpackbits(np.frombuffer(code, "u1"), bitorder="little").astype("i8")
    place = np.arange(len(bits))
    one = np.minimum.accumulate(np.where(bits > 0, place, len(bits))[::-1])[::-1]
    zeros = one - place
    legal = (zeros < 7) & (one + zeros < len(bits))
    size = np.zeros(len(bits), "i8")
    size[legal] = _fields(bits, one[legal], zeros[legal] + 1)
    after = (one + zeros + size).tolist()
    at, starts = 0, []
    for _ in range(n_values):
        if at >= len(bits) or not legal[at]:
            raise ValueError("the code ends before its values")
        starts.append(at)
        at = after[at]
    start = np.array(starts, "i8")
    width = size[start] - 1
    return _fields(bits, one[start] + zeros[start] + 1, width) | np.left_shift(np.int64(1), width)


def _s9_modes(values: np.ndarray) -> np.ndarray:
    """The mode that a word beginning at any value would take: the one with most values among
    those that hold the next ones (at the end of the values, all that are left)."""
    n, bits = len(values), np.maximum(_widths(values), 1)
    if n and bits.max() > 28:
        raise ValueError("a value needs more than 28 bits")
    mode = np.full(n, -1)
    for k, (count, width) in reversed(list(enumerate(zip(codes.S9_COUNTS, codes.S9_BITS, strict=True)))):
        wide = np.concatenate([[0], np.cumsum(bits > width)])
        mode[wide[np.minimum(np.arange(n) + count, n)] == wide[:n]] = k
    return mode


def s9_carry(values: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a segment of ``m`` values and those that follow: for each of 28 entry offsets the words
    that begin in it, and the offset at which the next segment is entered."""
    step = np.array(codes.S9_COUNTS)[_s9_modes(values)[:m]].tolist()
    words, leave = [0] * m + [0] * S9_OFFSETS, [0] * m + list(range(S9_OFFSETS))
    for at in range(m - 1, -1, -1):
        words[at], leave[at] = 1 + words[at + step[at]], leave[at + step[at]]
    return np.array(words[:S9_OFFSETS], "i8"), np.array(leave[:S9_OFFSETS], "i8")


def s9_pack(values: list[int] | np.ndarray) -> list[int]:
    """Simple-9 words as signed 32-bit integers; a short last word is filled with zeros."""
    values = np.asarray(values, "i8")
    return _s9_words(values, 0, len(values))[0]


def _s9_words(values: np.ndarray, entry: int, m: int) -> tuple[list[int], int]:
    """The words that begin from value ``entry`` on and before value ``m``, and where they end."""
    mode = _s9_modes(values)
    at, starts, step = entry, [], np.array(codes.S9_COUNTS)[mode].tolist()
    while at < m:
        starts.append(at)
        at += step[at]
    start = np.array(starts, "i8")
    word, padded = mode[start].astype("i8") << 28, np.concatenate([values, np.zeros(28, "i8")])
    for k, (count, width) in enumerate(zip(codes.S9_COUNTS, codes.S9_BITS, strict=True)):
        own = np.flatnonzero(mode[start] == k)
        for j in range(count):
            word[own] |= padded[start[own] + j] << (28 - width * (j + 1))
    return np.where(word >= 1 << 31, word - (1 << 32), word).tolist(), min(at, len(values))


def compose(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The map of two neighbours, as ``(words, leave)``."""
    return one[0] + two[0][one[1]], two[1][one[1]]


def _listed(ids: np.ndarray) -> list[int] | None:
    """Ids that do not count up from the first one."""
    return None if len(ids) and ids[-1] - ids[0] == len(ids) - 1 else ids.tolist()


def delta_encode(positions: DataFrame, n: int, form: str, segment: int = SEGMENT, state: DataFrame | None = None) -> DataFrame:
    """``(ref_id, seg, first, nvals, nbits, base, end, start, ids, marks, code)``; ``end``: the last
    cell; ``start``: the chain begins here. Chains go on from ``state`` if it is given."""
    ship(positions.sparkSession)
    if form == "pos":
        values = positions.select("ref_id", "obj_id", (F.col("pos") + 1).cast("long").alias("value"), F.lit(0).cast("long").alias("last"), F.lit(False).alias("first"))
    else:
        values = gap_values(positions, n, None, state).select("ref_id", "obj_id", (F.col("gap") + F.col("first").cast("long")).alias("value"), "last", "first")
    values = values.withColumn("seg", _segment(segment))

    def bucket(t: pa.Table) -> pa.Table:
        t = t.sort_by("obj_id")
        value, ids = t["value"].to_numpy(), t["obj_id"].to_numpy()
        nbits, code = delta_pack(value)
        base, start = t["last"][0].as_py(), t["first"][0].as_py()
        at, cell = np.cumsum(delta_widths(value)), base - int(start) + np.cumsum(value)
        places = range(0, len(value), EVERY)
        marks = [{"bit": int(at[k - 1]) if k else 0, "cell": int(cell[k - 1]) if k else base} for k in places] if form == "gap" else [{"bit": int(at[k - 1]) if k else 0, "cell": 0} for k in places]
        listed = pa.array([_listed(ids) if form == "pos" else None], pa.list_(pa.int64()))
        marked = pa.array([marks], pa.list_(pa.struct([("bit", pa.int64()), ("cell", pa.int64())])))
        end = int(cell[-1]) if form == "gap" else int(ids[-1] * n + value[-1] - 1)
        return pa.table({"ref_id": t["ref_id"][:1], "seg": t["seg"][:1], "first": t["obj_id"][:1], "nvals": [len(value)], "nbits": [nbits], "base": [base], "end": [end], "start": [start], "ids": listed, "marks": marked, "code": [code]})

    return values.groupBy("ref_id", "seg").applyInArrow(bucket, "ref_id long, seg long, first long, nvals long, nbits long, base long, end long, start boolean, ids array<long>, marks array<struct<bit:long,cell:long>>, code binary")


def delta_decode(buckets: DataFrame, n: int, form: str) -> DataFrame:
    """``(ref_id, obj_id, pos)``, row by row."""
    ship(buckets.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ref, first, n_values, base, start, ids, code in zip(*(c.to_pylist() for c in b.columns), strict=True):
                value = delta_unpack(code, n_values)
                cell = base - int(start) + np.cumsum(value)
                obj = cell // n if form == "gap" else np.array(ids, "i8") if ids else first + np.arange(n_values)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n_values, ref)), pa.array(obj), pa.array(cell % n if form == "gap" else value - 1)], ["ref_id", "obj_id", "pos"])

    return buckets.select("ref_id", "first", "nvals", "base", "start", "ids", "code").mapInArrow(decode, "ref_id long, obj_id long, pos long")


@F.udtf(returnType="found long")
class ReadBlock:
    """Reads delta codes from bit ``skip`` of ``code`` on. With ``low``: adds them to ``base`` until
    that is reached, and gives the sum if it is below ``low + n``; else the ``most``-th value."""

    def eval(self, code: bytes, skip: int, most: int, base: int, low: int | None, n: int):
        at, value = skip, 0

        def take(bits: int) -> int:
            nonlocal at
            x = 0
            for _ in range(bits):
                x, at = x << 1 | code[at >> 3] >> (at & 7) & 1, at + 1
            return x

        for _ in range(most):
            zeros = 0
            while not take(1):
                zeros += 1
            size = 1 << zeros | take(zeros)
            value = 1 << (size - 1) | take(size - 1)
            base += value
            if low is not None and base >= low:
                break
        if low is None or low <= base < low + n:
            yield (value if low is None else base,)


def delta_access(buckets: DataFrame, wanted: DataFrame, n: int, form: str, segment: int = SEGMENT) -> DataFrame:
    """``(ref_id, obj_id, pos)`` of the wanted ``(ref_id, obj_id)`` that are there. Rows are found by
    segment; of a row one block of at most ``EVERY`` values is cut out and read by a table
    function. The block is that of the object's place, or, in the gap form, the last one that
    counts from a cell before the object's."""
    ship(buckets.sparkSession)
    own = wanted.select(F.col("ref_id").alias("r"), F.col("obj_id").cast("long").alias("o")).withColumn("s", F.floor(F.col("o") / F.lit(segment)).cast("long"))
    at = buckets.join(own, (F.col("ref_id") == F.col("r")) & (F.col("seg") == F.col("s")))
    low = F.col("o") * n
    if form == "gap":
        block = F.greatest(F.size(F.filter("marks", lambda m: m["cell"] < low)) - 1, F.lit(0))
        at = at.withColumn("k", block).withColumn("most", F.least(F.lit(EVERY), (F.col("nvals") - F.col("k") * EVERY).cast("int"))).withColumn("low", low)
    else:
        place = F.when(F.col("ids").isNull(), F.col("o") - F.col("first")).otherwise(F.array_position("ids", F.col("o")) - 1)
        at = at.withColumn("i", place).where((F.col("i") >= 0) & (F.col("i") < F.col("nvals"))).withColumn("k", F.floor(F.col("i") / EVERY).cast("int"))
        at = at.withColumn("most", (F.col("i") % EVERY + 1).cast("int")).withColumn("low", F.lit(None).cast("long"))
    mark, after = F.get("marks", F.col("k")), F.get("marks", F.col("k") + 1)["bit"]
    byte = F.floor(mark["bit"] / 8).cast("int")
    size = F.floor(F.coalesce(after, F.col("nbits")) / 8).cast("int") - byte + 1
    base = mark["cell"] - F.when(F.col("start") & (F.col("k") == 0), 1).otherwise(0)
    cut = at.select("r", "o", F.substring("code", byte + 1, size).alias("code"), (mark["bit"] % 8).cast("int").alias("skip"), "most", base.alias("base"), "low")
    read = ReadBlock(*[F.col(c).outer() for c in ("code", "skip", "most", "base", "low")], F.lit(n))
    found = F.col("found") - F.col("o") * n if form == "gap" else F.col("found") - 1
    return cut.lateralJoin(read).select(F.col("r").alias("ref_id"), F.col("o").alias("obj_id"), found.alias("pos"))


def _chains(positions: DataFrame, segment: int) -> DataFrame:
    """``(ref_id, seg, cells, last, halo)``: a segment's objects and positions, the one before it
    and the 27 after it. Of the other segments only ends and heads are gathered."""
    pairs = F.array_sort(F.collect_list(F.struct("obj_id", "pos")))
    own = positions.select("ref_id", "obj_id", "pos", _segment(segment).alias("seg")).groupBy("ref_id", "seg").agg(pairs.alias("cells"))
    order = Window.partitionBy("ref_id").orderBy("seg")
    after = F.flatten(F.collect_list("head").over(order.rowsBetween(1, S9_OFFSETS - 1)))
    edge = own.select("ref_id", "seg", F.element_at("cells", -1).alias("end"), F.slice("cells", 1, S9_OFFSETS - 1).alias("head"))
    return _in_place(own).join(edge.select("ref_id", "seg", F.lag("end").over(order).alias("last"), F.slice(after, 1, S9_OFFSETS - 1).alias("halo")), ["ref_id", "seg"])


def _s9_values(b: pa.RecordBatch, k: int, n: int, form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Row ``k`` of a chain's segments: ids, values, cells before, which gaps were too wide, and
    how many of the values are the segment's own."""
    cells, halo = b.column("cells")[k].values, b.column("halo")[k].values
    obj, pos = (np.concatenate([x.field(j).to_numpy() for x in (cells, halo)]) for j in (0, 1))
    if form == "pos":
        return obj, pos, np.zeros(len(obj), "i8"), np.zeros(len(obj), bool), len(cells)
    last = b.column("last")[k].as_py()
    cell = obj * n + pos
    before = np.r_[last["obj_id"] * n + last["pos"] if last else obj[0] * n, cell[:-1]]
    wide = cell - before >= codes.S9_LIMIT
    return obj, np.where(wide, n + pos - before % n, cell - before), before, wide, len(cells)


def _entered(t: pa.Table, at: int) -> list[int]:
    """Offsets at which consecutive maps are entered."""
    out = []
    for leave in t["leave"].to_pylist():
        out.append(at)
        at = leave[at]
    return out


def _s9_maps(chains: DataFrame, n: int, form: str) -> DataFrame:
    """``(ref_id, seg, blk, words, leave)``: the map of every segment, with its block."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [s9_carry(value, m) for _, value, _, _, m in (_s9_values(b, k, n, form) for k in range(b.num_rows))]
            lists = [pa.array([list(x[j]) for x in found], pa.list_(pa.int64())) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("ref_id"), b.column("seg"), *lists], ["ref_id", "seg", "words", "leave"])

    maps = chains.mapInArrow(carry, "ref_id long, seg long, words array<long>, leave array<long>")
    return maps.withColumn("blk", F.floor(F.col("seg") / S9_BLOCK).cast("long"))


def _s9_composed(maps: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """``(keys, words, leave)``: the maps of each group, composed in their order."""

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by(order)
        both = reduce(compose, [tuple(np.array(t[c][k].as_py(), "i8") for c in ("words", "leave")) for k in range(t.num_rows)])
        return pa.table({**{k: t[k][:1] for k in keys}, "words": [both[0]], "leave": [both[1]]})

    return maps.groupBy(*keys).applyInArrow(total, ", ".join(f"{k} long" for k in keys) + ", words array<long>, leave array<long>")


def s9_words(positions: DataFrame, n: int, form: str, segment: int = SEGMENT) -> DataFrame:
    """``(ref_id, words)`` per pivot, and the total under a null ``ref_id``: from the composed maps,
    without making a word."""
    ship(positions.sparkSession)
    blocks = _s9_composed(_s9_maps(_chains(positions, segment), n, form), ("ref_id", "blk"), "seg")
    return _with_total(_s9_composed(blocks, ("ref_id",), "blk").select("ref_id", F.col("words")[0].alias("words")))


def s9_entries(maps: DataFrame) -> DataFrame:
    """``(ref_id, seg, entry)`` from the segments' maps: blocks of segments are composed, then
    blocks are entered one after the other, then their segments."""

    def enter(t: pa.Table) -> pa.Table:
        t = t.sort_by("blk")
        return pa.table({"ref_id": t["ref_id"], "blk": t["blk"], "at": _entered(t, 0)})

    def inside(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg")
        return pa.table({"ref_id": t["ref_id"], "seg": t["seg"], "entry": _entered(t, t["at"][0].as_py())})

    starts = _s9_composed(maps, ("ref_id", "blk"), "seg").groupBy("ref_id").applyInArrow(enter, "ref_id long, blk long, at long")
    return _in_place(maps).join(starts, ["ref_id", "blk"]).groupBy("ref_id", "blk").applyInArrow(inside, "ref_id long, seg long, entry long")


def s9_encode(positions: DataFrame, n: int, form: str, segment: int = SEGMENT) -> DataFrame:
    """``(ref_id, seg, first, nvals, base, ids, words)``: the words that begin in a segment. A
    segment that lies inside one word has no row."""
    ship(positions.sparkSession)
    chains = _chains(positions, segment)

    entries = s9_entries(_s9_maps(chains, n, form))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k in range(b.num_rows):
                obj, value, before, wide, m = _s9_values(b, k, n, form)
                entry = b.column("entry")[k].as_py()
                if entry >= m:
                    continue
                words, end = _s9_words(value, entry, m)
                ids = obj[entry:end]
                listed = _listed(ids) if form == "pos" else ids.tolist() if wide[entry:end].any() else None
                rows.append({"ref_id": b.column("ref_id")[k].as_py(), "seg": b.column("seg")[k].as_py(), "first": int(ids[0]), "nvals": len(ids), "base": int(before[entry]), "ids": listed, "words": words})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _S9_SCHEMA)

    return _in_place(chains).join(entries, ["ref_id", "seg"]).mapInArrow(pack, "ref_id long, seg long, first long, nvals long, base long, ids array<long>, words array<int>")


def s9_decode(buckets: DataFrame, n: int, form: str) -> DataFrame:
    """``(ref_id, obj_id, pos)``. No Python: words are unpacked by array functions."""
    count = F.sequence(F.lit(0).cast("long"), F.col("nvals") - 1)
    ids = F.coalesce("ids", F.transform(count, lambda i: F.col("first") + i) if form == "pos" else F.transform(count, lambda i: F.lit(None).cast("long")))
    both = F.arrays_zip(codes.s9_unpack(F.col("words"), F.col("nvals")).alias("value"), ids.alias("id"))
    rows = buckets.select("ref_id", "seg", "base", F.posexplode(both).alias("i", "x")).select("ref_id", "seg", "base", "i", "x.value", "x.id")
    if form == "pos":
        return rows.select("ref_id", F.col("id").alias("obj_id"), F.col("value").alias("pos"))
    chain = Window.partitionBy("ref_id", "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cell = F.col("base") + F.sum("value").over(chain)
    return rows.select("ref_id", "id", cell.alias("cell")).select("ref_id", F.coalesce("id", codes.cell_object(F.col("cell"), n)).alias("obj_id"), codes.cell_position(F.col("cell"), n).alias("pos"))


def s9_sizes(buckets: DataFrame) -> DataFrame:
    """``(ref_id, words)`` per pivot, and the total under a null ``ref_id``."""
    return _with_total(buckets.groupBy("ref_id").agg(F.sum(F.size("words")).cast("long").alias("words")))


def collect_positions(positions: DataFrame) -> DataFrame:
    """``(obj_id, pos)`` arrays from long rows, as a search needs them."""
    return positions.groupBy("obj_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "pos"))), lambda x: x["pos"].cast("int")).alias("pos"))
