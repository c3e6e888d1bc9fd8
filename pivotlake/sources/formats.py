"""Data sources: sectioned text to read, answer lines to write and read.

``spark.read.format("sections")`` gives ``(id, v)`` of one section of a sectioned text (see
``sections`` for layouts and selections). A file is read by byte ranges: a token belongs to the
range in which it begins, a vector to that of its first token, whose reader goes on to the
vector's end. A task walks through the neighbouring ranges of one file, ``TASK`` bytes together
or one range, and counts on from one to the next. For ids, it must know how many tokens stand before its
first range. ``read_section`` has them counted by a first job over the same tasks and hands the
sums on as the option ``starts`` (``read_parts`` does so once for all sections); without it the
planner counts by itself, up to ``PLANNED`` bytes.

``df.write.format("answer_lines")`` writes the column ``line``, one file a task. A task writes under
a name of its own attempt; the files get their names when the job commits, so a task that fails
and runs again leaves no line twice, and a job that fails leaves none. ``overwrite`` removes the
former files at commit.

Paths are those that pyarrow's file systems open (local, hdfs, s3, gs). Options of ``sections``:
``layout``, ``section``, ``n_objects``, ``n_refs``, ``n_queries``, ``integers``, ``strict_sections``, ``block``
(bytes of a range), ``starts``. Defined results: too few tokens, an unknown layout or section and a
selection beyond the section are errors; an empty section gives no row.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pivotlake.functions.shipping import ship
from pivotlake.sources.sections import LAYOUTS

#: Bytes of a range; bytes of a task's ranges; bytes that the planner counts without a job; bytes
#: read on at a time.
BLOCK, TASK, PLANNED, MORE = 8 << 20, 4 << 20, 64 << 20, 1 << 16
_SPACE = b" \t\n\r\x0b\x0c"
SECTIONS = ("objects", "refs", "queries")


def _files(path: str) -> tuple[pafs.FileSystem, list[tuple[str, int]]]:
    """Data files by name with their sizes."""
    fs, at = pafs.FileSystem.from_uri(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"{path} is not there")
    found = [info] if info.type == pafs.FileType.File else [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.type == pafs.FileType.File and x.base_name[0] not in "._"]
    return fs, sorted((x.path, x.size) for x in found)


def tokens_of(fs: pafs.FileSystem, file: str, start: int, end: int, more: int = 0) -> tuple[list[bytes], int]:
    """The tokens that begin in ``[start, end)``, their number, and up to ``more`` tokens after
    them in the list."""
    with fs.open_input_file(file) as f:
        size = f.size()
        data = f.read_at(min(end, size) - max(start - 1, 0), max(start - 1, 0))
        at = min(end, size)
        if start:  # what goes on from the range before is its own
            cut = 0 if data[:1] in (b"", *(bytes([c]) for c in _SPACE)) else re.search(rb"[ \t\n\r\x0b\x0c]|$", data).start()
            data = data[cut:]
        n = len(data.split())
        # to the end of the last token, and of those that are wanted beyond
        while at < size and (more or data[-1:] not in (b"", *(bytes([c]) for c in _SPACE))):
            extra = f.read_at(min(MORE, max(1 << 10, 32 * more), size - at), at)
            at += len(extra)
            data += extra
            if len(data.split()) > n + more:
                break
    return data.split()[: n + more], n


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    first: int  # number of its first token

    def blocks(self, size: int) -> Iterator[tuple[int, int]]:
        """Its byte ranges of ``size`` bytes."""
        for at in range(self.start, self.end, size):
            yield at, min(at + size, self.end)


class SectionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = {k.lower(): v for k, v in options.items()}
        self.path = self.options["path"]
        self.section = self.options.get("section", "objects")
        self.block = int(self.options.get("block", BLOCK))
        if self.section not in (*SECTIONS, "counts"):
            raise ValueError(f"section: {self.section}; known: {', '.join(SECTIONS)}")
        if self.section != "counts":
            self.dim, self.begin, self.wanted, self.needed = self.plan()

    def plan(self) -> tuple[int, int, int, int]:
        """Dimensions, the section's first token, the vectors selected, all tokens of the file."""
        layout = self.options.get("layout", "refs_first")
        if layout not in LAYOUTS:
            raise ValueError(f"layout: {layout}; known: {', '.join(LAYOUTS)}")
        fs, files = _files(self.path)
        head: list[bytes] = []
        for file, size in files:
            head += tokens_of(fs, file, 0, min(size, MORE))[0]
            if len(head) >= 4:
                break
        if len(head) < 4:
            raise ValueError(f"{self.path}: no header of four integers")
        dim, *sizes = map(int, head[:4])
        order = [*LAYOUTS[layout], "queries"]
        total = dict(zip(order, sizes, strict=True))
        chosen = {k: int(self.options.get(f"n_{k}", total[k])) for k in order}
        at = 4
        for k in order:
            if not 0 <= chosen[k] <= total[k]:
                raise ValueError(f"{chosen[k]} of {total[k]} {k} selected")
            if k == self.section:
                begin = at
            at += dim * (total[k] if self.options.get("strict_sections", "true").lower() == "true" else chosen[k])
        return dim, begin, chosen[self.section], 4 + dim * sum(total.values())

    def ranges(self) -> list[Range]:
        """A task's ranges each: as many whole ones as ``TASK`` bytes hold, one at least."""
        step = max(1, TASK // self.block) * self.block
        return [Range(file, at, min(at + step, size), -1) for file, size in _files(self.path)[1] for at in range(0, size, step)]

    def count(self, fs: pafs.FileSystem, part: Range) -> int:
        return sum(tokens_of(fs, part.file, *own)[1] for own in part.blocks(self.block))

    def partitions(self) -> list[Range]:
        found = self.ranges()
        if self.section == "counts":
            return found
        if "starts" in self.options:
            counts = json.loads(self.options["starts"])
        else:
            fs, files = _files(self.path)
            if sum(size for _, size in files) > PLANNED:
                raise ValueError("the option starts is needed; read_section finds it by a job")
            counts = [self.count(fs, x) for x in found]
        if len(counts) != len(found):
            raise ValueError(f"{len(counts)} counts for {len(found)} ranges: the file has changed")
        if sum(counts) < self.needed:
            raise ValueError(f"{self.path}: {sum(counts)} tokens, {self.needed} by the header")
        out, at = [], 0
        stop = self.begin + self.dim * self.wanted
        for x, n in zip(found, counts, strict=True):
            if at < stop and at + n > self.begin:  # ranges without a wanted token are skipped
                out.append(Range(x.file, x.start, x.end, at))
            at += n
        return out or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        fs = pafs.FileSystem.from_uri(self.path)[0]
        if self.section == "counts":
            n = self.count(fs, part)
            yield pa.RecordBatch.from_pydict({"file": [part.file], "start": pa.array([part.start], pa.int64()), "n": pa.array([n], pa.int64())})
            return
        first = part.first
        for start, end in part.blocks(self.block):
            n, found = self.vectors(fs, part.file, start, end, first)
            first += n
            if found is not None:
                yield found

    def vectors(self, fs: pafs.FileSystem, file: str, start: int, end: int, first: int) -> tuple[int, pa.RecordBatch | None]:
        """A range's number of tokens, and the vectors whose first token, ``first`` being the number
        of the range's, is among its own."""
        own, n = tokens_of(fs, file, start, end, max(self.dim - 1, 0))
        one = max(0, -((self.begin - first) // self.dim) if self.dim else 0)
        last = min(self.wanted, -((self.begin - first - n) // self.dim) if self.dim else 0)
        if last <= one:
            return n, None
        at = self.begin + one * self.dim - first
        have = own[at : at + (last - one) * self.dim]
        if len(have) < (last - one) * self.dim:  # a vector goes on in the next file
            have += self.next_tokens(fs, file, (last - one) * self.dim - len(have))
        if self.options.get("integers", "false").lower() == "true":
            have = [int(x) for x in have]
        v = np.array(have).astype("f8")
        return n, pa.RecordBatch.from_pydict({"id": pa.array(np.arange(one, last), pa.int64()), "v": pa.ListArray.from_arrays(pa.array(np.arange(0, len(v) + 1, self.dim), pa.int32()), pa.array(v))})

    def next_tokens(self, fs: pafs.FileSystem, file: str, n: int) -> list[bytes]:
        out: list[bytes] = []
        for name, size in _files(self.path)[1]:
            at = 0
            while name > file and at < size and len(out) < n:
                out += tokens_of(fs, name, at, min(at + MORE, size))[0]
                at += MORE
        return out[:n]


class SectionSource(DataSource):
    """Reads one section of sectioned text."""

    @classmethod
    def name(cls) -> str:
        return "sections"

    def schema(self) -> str:
        return "file string, start long, n long" if self.options.get("section") == "counts" else "id long, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        return SectionReader(self.options)


def read_parts(spark: SparkSession, path: str, layout: str, names: tuple[str, ...] = SECTIONS, **options) -> list[DataFrame]:
    """``(id, v)`` of each of the sections; tokens are counted by one job for all of them, one number
    a task comes to the driver."""
    use(spark)
    own = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if v is not None}
    load = lambda **more: spark.read.format("sections").options(path=path, layout=layout, **own, **more).load()
    counts = sorted((r["file"], r["start"], r["n"]) for r in load(section="counts").collect())
    starts = json.dumps([n for *_, n in counts])
    return [load(section=name, starts=starts) for name in names]


def read_section(spark: SparkSession, path: str, layout: str, section: str, **options) -> DataFrame:
    """``(id, v)`` of a section."""
    return read_parts(spark, path, layout, (section,), **options)[0]


# --- answer lines -----------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str


class LineWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, at = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{at}/_lines-{self.job}", recursive=True)
        file = f"{at}/_lines-{self.job}/{task.partitionId()}-{uuid.uuid4().hex}"
        with fs.open_output_stream(file) as out:
            for b in batches:
                out.write("".join(f"{x}\n" for x in b.column("line").to_pylist()).encode())
        return Written(task.partitionId(), file)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for name, _ in _files(self.path)[1]:
                fs.delete_file(name)
        for m in messages:
            if m is not None:
                fs.move(m.file, f"{at}/lines-{m.partition:06d}-{self.job}.txt")
        self.drop(fs, at)

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(*pafs.FileSystem.from_uri(self.path))

    def drop(self, fs: pafs.FileSystem, at: str) -> None:
        """Attempts that do not count go with the job's folder."""
        if fs.get_file_info(f"{at}/_lines-{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/_lines-{self.job}")


@dataclass
class File(InputPartition):
    name: str


class LineReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(name) for name, _ in _files(self.path)[1]] or [File("")]

    def read(self, part: File) -> Iterator[tuple[str, int, list[int]]]:
        if part.name:
            with pafs.FileSystem.from_uri(self.path)[0].open_input_stream(part.name) as f:
                n, rest = 0, b""
                while data := f.read(MORE):
                    *lines, rest = (rest + data).split(b"\n")
                    for line in lines:
                        yield part.name.rsplit("/", 1)[-1], n, [int(x) for x in line.split()]
                        n += 1


class AnswerLines(DataSource):
    """Lines of ids. Read: ``(file, n, ids)``, ``n`` from 0 in each file."""

    @classmethod
    def name(cls) -> str:
        return "answer_lines"

    def schema(self) -> str:
        return "file string, n long, ids array<long>"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> LineWriter:
        if "line" not in schema.fieldNames():
            raise ValueError("a column line is needed")
        return LineWriter(self.options["path"], overwrite)


def use(spark: SparkSession) -> None:
    """Make both formats known to the session, and the package to its workers."""
    ship(spark)
    spark.dataSource.register(SectionSource)
    spark.dataSource.register(AnswerLines)


def write_answer_lines(lines: DataFrame, path: str) -> None:
    """``(q_id, line)`` in the order of the queries: files by name, lines inside them."""
    use(lines.sparkSession)
    lines.repartitionByRange("q_id").sortWithinPartitions("q_id").select("line").write.format("answer_lines").mode("overwrite").option("path", path).save()
