"""Permutations stored as a wavelet matrix, read by counting.

The permutations of a segment's objects, one after the other, are a sequence of symbols. Level by
level, from the highest bit of a symbol down, the bits are stored and the symbols are dealt
stably into those with a 0 and those with a 1. A symbol is read without unpacking anything: its
bit at a level tells which part it went to, and the number of equal bits before it its place
there. Numbers of ones are kept for every ``BLOCK`` bits, so that counting reads one block a level.

A row is a segment of at most ``SYMBOLS`` symbols: ``(seg, first, ids, width, levels)``; ``ids`` are the
objects' where they do not count up from ``first``, ``levels`` holds bits (from the low end of each
byte), counts before each block, and the zeros. Look-ups are dealt to their segments; ``salts``
spreads those of one segment over several tasks. Objects that are not there give no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship

BLOCK, SYMBOLS = 512, 1 << 20
_LEVEL = "array<struct<bits:binary,counts:array<int>,zeros:int>>"


def segment_of(n: int) -> int:
    """Ids of a segment for permutations of ``n``."""
    return max(1, SYMBOLS // max(n, 1))


def build_levels(symbols: np.ndarray, width: int) -> list[dict]:
    out = []
    for level in range(width):
        one = (symbols >> (width - 1 - level) & 1).astype(bool)
        before = np.r_[0, np.cumsum(np.add.reduceat(one, np.arange(0, len(one), BLOCK)))[:-1]] if len(one) else []
        out.append({"bits": np.packbits(one, bitorder="little").tobytes(), "counts": list(map(int, before)), "zeros": int((~one).sum())})
        symbols = np.r_[symbols[~one], symbols[one]]
    return out


def access(levels: list[dict], at: np.ndarray) -> np.ndarray:
    """The symbols at places ``at``, all at once."""
    symbol = np.zeros(len(at), "i8")
    for level in levels:
        bits = np.frombuffer(level["bits"], "u1")
        block = at // BLOCK
        # the bytes of each block up to the place, and the bits under it in the last one
        byte, inside = at // 8, at % 8
        own = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)[None, :]
        whole = np.bitwise_count(bits[np.minimum(own, len(bits) - 1)]) * (own < byte[:, None])
        ones = np.array(level["counts"], "i8")[block] + whole.sum(1, dtype="i8") + np.bitwise_count(bits[byte] & ((1 << inside) - 1).astype("u1")).astype("i8")
        bit = bits[byte].astype("i8") >> inside & 1
        symbol = symbol << 1 | bit
        at = np.where(bit, level["zeros"] + ones, at - ones)
    return symbol


def encode(index: DataFrame, n: int) -> DataFrame:
    """Segments from an index ``(obj_id, perm)`` over ``n`` pivots."""
    ship(index.sparkSession)
    width = max(1, (n - 1).bit_length())

    def segment(t: pa.Table) -> pa.Table:
        t = t.sort_by("obj_id")
        ids, symbols = t["obj_id"].to_numpy(), t["perm"].combine_chunks().flatten().to_numpy().astype("i8")
        listed = None if ids[-1] - ids[0] == len(ids) - 1 else ids.tolist()
        levels = pa.array([build_levels(symbols, width)], pa.list_(pa.struct([("bits", pa.binary()), ("counts", pa.list_(pa.int32())), ("zeros", pa.int32())])))
        return pa.table({"seg": t["seg"][:1], "first": t["obj_id"][:1], "nobjs": [len(ids)], "ids": pa.array([listed], pa.list_(pa.int64())), "levels": levels})

    own = index.select("obj_id", "perm", F.floor(F.col("obj_id") / segment_of(n)).cast("long").alias("seg"))
    return own.groupBy("seg").applyInArrow(segment, f"seg long, first long, nobjs long, ids array<long>, levels {_LEVEL}")


def read_symbols(segments: DataFrame, wanted: DataFrame, n: int, salts: int = 1) -> DataFrame:
    """``(obj_id, rank, ref_id)`` of the wanted ``(obj_id, rank)``, ranks from 0."""
    ship(segments.sparkSession)

    def look(rows: pa.Table, asked: pa.Table) -> pa.Table:
        obj, rank = asked["obj_id"].to_numpy(), asked["rank"].to_numpy()
        if rows.num_rows:
            first, count, ids, levels = (rows[c][0].as_py() for c in ("first", "nobjs", "ids", "levels"))
            place = np.searchsorted(ids, obj) if ids else obj - first
            there = (place >= 0) & (place < count) & (rank >= 0) & (rank < n)
            if ids:
                there &= np.array(ids)[np.minimum(place, count - 1)] == obj
            obj, rank, place = obj[there], rank[there], place[there]
            found = np.concatenate([access(levels, place[k : k + 4096] * n + rank[k : k + 4096]) for k in range(0, len(place), 4096)] or [np.empty(0, "i8")])
        else:
            obj, rank, found = obj[:0], rank[:0], np.empty(0, "i8")
        return pa.table({"obj_id": pa.array(obj, pa.int64()), "rank": pa.array(rank, pa.int64()), "ref_id": pa.array(found, pa.int64())})

    salt = F.pmod(F.xxhash64("obj_id", "rank"), F.lit(salts)).cast("int")
    asked = wanted.select(F.col("obj_id").cast("long").alias("obj_id"), F.col("rank").cast("long").alias("rank")).withColumn("s", F.floor(F.col("obj_id") / segment_of(n)).cast("long")).withColumn("salt", salt)
    rows = segments.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.groupBy("seg", "salt").cogroup(asked.groupBy("s", "salt")).applyInArrow(look, "obj_id long, rank long, ref_id long")


def sizes(segments: DataFrame) -> DataFrame:
    """``(bit_bytes, count_bytes)``: what the levels take, measured."""
    bits = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.length(x["bits"]))
    counts = F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + 4 * F.size(x["counts"]))
    return segments.agg(F.coalesce(F.sum(bits), F.lit(0)).alias("bit_bytes"), F.coalesce(F.sum(counts), F.lit(0)).alias("count_bytes"))
