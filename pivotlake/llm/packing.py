"""Packing token sequences by minimum bin slack.

Texts become token ids plus an end id; only longer ones are cut, into full-length pieces and
a rest. What remains is a bin-packing problem over piece lengths, and there are at most as
many lengths as a bin has places. So the histogram of lengths, a table bounded by the bin
size and not by the corpus, is all that the packer needs: for the longest remaining length
it seeks, by subset sums held in bitsets over the lengths still available, the fullest
combination that fits with it, removes that combination, and does so as many times as the
counts allow. The result is a list of patterns; the pieces of each length are numbered and
the numbers are looked up in the patterns.

Tokens: ids depend on a white-space-free chunk alone, because the tokenizer's patterns never
match across white space, so ids are kept per chunk in a bounded cache and most chunks are
encoded only once per task. Chunks of plain Latin-1 letters and marks are merged by the
vocabulary's ranks directly; all others go through the tokenizer itself. This holds for
tokenizer files of one make (``_merges_by_rank``); texts go whole through any other tokenizer.

Defined results: null and empty texts are the end id alone; rows that repeat are pieces of
their own; null ids pass through; an empty table gives an empty table. Other columns are
not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pivotlake.functions.shipping import ship
from pivotlake.llm.common import lean, materialize, table

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks whose ids one task keeps at most (some 500 bytes each).
CACHED_CHUNKS = 200_000
#: Numbering of equal lengths is spread over so many buckets at least, and over more where
#: they would hold more than so many pieces each.
BUCKETS, BUCKET_ROWS = 64, 1_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Python counts these as white space, the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _merges_by_rank(spec: dict) -> bool:
    """Whether a tokenizer file is of the make whose chunks can be merged by rank: composed,
    lower-cased, split by one pattern into words of bytes that end in a mark."""
    model, norm, pre = (spec.get(k) or {} for k in ("model", "normalizer", "pre_tokenizer"))
    kinds = lambda parts: [x["type"] for x in parts]
    return (
        (model.get("type"), model.get("end_of_word_suffix"), model.get("continuing_subword_prefix"), bool(model.get("ignore_merges"))) == ("BPE", "</w>", None, False)
        and kinds(norm.get("normalizers", [])) == ["NFC", "Replace", "Lowercase"]
        and kinds(pre.get("pretokenizers", [])) == ["Split", "ByteLevel"]
        and (pre["pretokenizers"][0]["behavior"], pre["pretokenizers"][0]["invert"], pre["pretokenizers"][1]["add_prefix_space"]) == ("Removed", True, False)
    )


class ChunkIds(dict):
    """chunk -> its ids as little-endian unsigned 32-bit bytes, filled on demand."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_rank = _merges_by_rank(spec)
        if not self.by_rank:
            return
        # the alphabet: printable characters stand for the 256 bytes
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        # 0xff ends a word: no UTF-8 text holds that byte; ids are the merge ranks
        ranks = {}
        for token, rank in spec["model"]["vocab"].items():
            ended = token.endswith("</w>") and len(token) > 4
            ranks[bytes(byte_of[c] for c in (token[:-4] if ended else token)) + (b"\xff" if ended else b"")] = rank
        ranks.setdefault(b"\xff", 1 << 20)
        self.merge = tiktoken.Encoding("chunks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = tuple(t["content"] for t in spec["added_tokens"])

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        if chunk.isalpha() and self._plain(chunk):
            ids = self.merge(chunk.lower().encode() + b"\xff")
        elif chunk[-1] in ".,;:" and chunk[:-1].isalpha() and self._plain(chunk):
            self[chunk] = found = self[chunk[:-1]] + self[chunk[-1]]
            return found
        elif self._plain(chunk) and not any(s in chunk for s in self.special):
            ids = [i for part in self.split(chunk.lower()) for i in self.merge(part.encode() + b"\xff")]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        found = pack(f"<{len(ids)}I", *ids)
        if len(chunk) < 64:
            self[chunk] = found
        return found

    @staticmethod
    def _plain(chunk: str) -> bool:
        """Normal form and lower case of Latin-1 are simple; very long chunks go elsewhere."""
        return chunk.isascii() or max(chunk) <= "\xff"

    def encode(self, text: str) -> bytes:
        if not self.by_rank or _ODD_SPACE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``PIECES``: the pieces of every row. ``tokenizer`` names a public tokenizer file; each
    executor opens its own copy."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pivotlake.llm import packing  # the worker's own module keeps the tokenizer between tasks

        known = packing.chunk_ids(packing._tokenizer_path(tokenizer))
        encode = known.encode
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = encode(t.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    ids.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])
        known.clear()  # idle workers would hold some 100 MB each; a task's own chunks fill it as well

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(lean(cut), PIECES)


def fullest(counts: list[int], first: int, capacity: int) -> dict[int, int]:
    """The fullest multiset of available lengths that holds ``first`` and fits: subset sums
    as bits of an integer, one layer per batch of equal items (powers of two make up every
    count), longest lengths first, until the bin is full; then the layers are walked back."""
    room = capacity - first
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in range(min(room, first), 0, -1):
        left = min(counts[length] - (length == first), room // length)
        batch = 1
        while left > 0:
            n = min(batch, left)
            new = reach | (reach << (n * length)) & mask
            if new != reach:
                layers.append((reach, length, n))
                reach = new
            left -= n
            batch *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {first: 1}
    for before, length, n in reversed(layers):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + n
            at -= n * length
    return out


def pack_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """``(times, {length: items})`` patterns that use up the histogram. A combination is
    removed as often as the counts allow, so the number of searches is bounded by the number
    of lengths and not by the number of pieces."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] += n
    out, first = [], capacity
    while True:
        while first and not counts[first]:
            first -= 1
        if not first:
            return out
        pattern = fullest(counts, first, capacity)
        times = min(counts[length] // n for length, n in pattern.items())
        for length, n in pattern.items():
            counts[length] -= times * n
        out.append((times, pattern))


class Slots:
    """For each length, ranges of piece numbers with their pattern's first sequence, items
    per sequence and offsets."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]):
        ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for times, pattern in patterns:
            offset = 0
            for length in sorted(pattern, reverse=True):
                n = pattern[length]
                ranges.setdefault(length, []).append((used.get(length, 0), sequence, n, offset))
                used[length] = used.get(length, 0) + times * n
                offset += n * length
            sequence += times
        self.ranges = {k: np.array(v, "i8").T for k, v in ranges.items()}

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), "i8"), np.empty(len(length), "i8")
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            one = int(length[own[0]])
            first, base, n, at = self.ranges[one]
            k = np.searchsorted(first, number[own], side="right") - 1
            inside = number[own] - first[k]
            sequence[own] = base[k] + inside // n[k]
            offset[own] = at[k] + inside % n[k] * one
        return sequence, offset


def number_pieces(pieces: DataFrame, buckets: int = BUCKETS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``number``: 0, 1, ... among the pieces of one length. Pieces are numbered inside
    buckets of a hash of their identity; a length gets as many buckets as its count asks
    for, so that one common length does not bound the run. The buckets' first numbers are
    sums of counts, a table of capacity x buckets + pieces / bucket_rows rows at most."""
    wide = F.greatest(F.lit(buckets), F.ceil(F.count("*") / bucket_rows)).alias("n_buckets")
    dealt = F.broadcast(pieces.groupBy("length").agg(wide))  # a row per length: capacity rows at most
    keyed = pieces.join(dealt, "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("n_buckets"))).drop("n_buckets")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return keyed.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(firsts), ["length", "bucket"]).withColumn("number", F.col("first") + F.col("_own")).drop("_own", "first", "bucket")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``pieces`` must be a stored table: it
    is read twice. At most ``capacity`` histogram rows come to the driver."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = Slots(pack_lengths(histogram, capacity))
    shared = pieces.sparkSession.sparkContext.broadcast(slots.ranges)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Slots([])
        own.ranges = shared.value
        for b in batches:
            t = pa.Table.from_batches([b])
            sequence, offset = own.place(t["length"].to_numpy(), t["number"].to_numpy())
            t = t.drop_columns(["number"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
            yield from t.to_batches()

    numbered = number_pieces(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    return numbered.mapInArrow(lean(place), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """``PIECES`` with ``sequence_id`` and ``offset`` for every row of ``docs``."""
    return pack_pieces(materialize(cut_pieces(docs, **options), "pieces"), options.get("capacity", CAPACITY))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
