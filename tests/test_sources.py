"""The data source, the sink and the program."""

import random

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from pivotlake import program
from pivotlake.operators import index, search
from pivotlake.sources import formats, sections


def text_of(rng, dim, sizes, breaks=" \n\t\r\x0b"):
    """Sectioned text with odd white space, and its vectors in order."""
    n = sum(sizes)
    numbers = [str(rng.choice([rng.randrange(-99, 99), rng.random(), 1e-9])) for _ in range(dim * n)]
    gap = lambda: "".join(rng.choice(breaks) for _ in range(rng.randrange(1, 4)))
    tokens = [str(dim), *map(str, sizes), *numbers]
    return gap() + "".join(t + gap() for t in tokens), [list(map(float, numbers[k * dim : (k + 1) * dim])) for k in range(n)]


@pytest.mark.parametrize("block", [7, 300])
def test_sections_by_ranges(spark, tmp_path, block):
    rng = random.Random(block)
    text, vectors = text_of(rng, 3, (5, 40, 7))
    folder = tmp_path / "text"
    folder.mkdir()
    cut = sorted(k for k in rng.sample(range(len(text)), 12) if text[k].isspace())[:2] + [len(text)]
    for k, (low, high) in enumerate(zip([0, *cut], cut, strict=False)):
        (folder / f"part-{k}").write_text(text[low:high], newline="")
    (tmp_path / "one.txt").write_text(text, newline="")
    for path in (folder, tmp_path / "one.txt"):
        for name, low, high in (("refs", 0, 5), ("objects", 5, 45), ("queries", 45, 52)):
            got = formats.read_section(spark, str(path), "refs_first", name, block=block)
            assert [list(r["v"]) for r in got.orderBy("id").collect()] == vectors[low:high]
            assert [r["id"] for r in got.orderBy("id").collect()] == list(range(high - low))
    few = formats.read_section(spark, str(folder), "objects_first", "queries", block=block, n_objects=2, n_refs=3, n_queries=1, strict_sections=False)
    assert [list(r["v"]) for r in few.collect()] == [vectors[5]]


def test_source_equals_the_reader(spark, tmp_path):
    text, _ = text_of(random.Random(2), 4, (6, 30, 3), " \n")
    (tmp_path / "t.txt").write_text(text)
    read = sections.read_sections(spark, str(tmp_path / "t.txt"), "objects_first", n_refs=4)
    for part, name in ((read.objects, "objects"), (read.pivots, "refs"), (read.queries, "queries")):
        assert sorted(map(tuple, formats.read_section(spark, str(tmp_path / "t.txt"), "objects_first", name, n_refs=4).collect())) == sorted(map(tuple, part.collect()))
    # the planner counts small files by itself; only one section's ranges are read
    formats.use(spark)
    plain = spark.read.format("sections").options(path=str(tmp_path / "t.txt"), layout="objects_first", section="queries").load()
    assert plain.count() == 3 and plain.schema.simpleString() == "struct<id:bigint,v:array<double>>"


@pytest.mark.parametrize(("text", "options", "what"), [("2 1 1", {}, "no header"), ("2 1 1 1 1 2 3", {}, "tokens"), ("1 1 1 1 5 6 7", {"n_objects": 2}, "selected"), ("1 1 1 1 5 6 7", {"section": "rows"}, "section"), ("1 1 1 1 5 6 7", {"layout": "x"}, "layout")])
def test_source_refuses(spark, tmp_path, text, options, what):
    (tmp_path / "t.txt").write_text(text)
    formats.use(spark)
    with pytest.raises(Exception, match=what):
        spark.read.format("sections").options(path=str(tmp_path / "t.txt"), **options).load().collect()
    with pytest.raises(Exception, match="not there"):
        spark.read.format("sections").options(path=str(tmp_path / "none")).load().collect()


def files(path):
    return sorted(x.base_name for x in pafs.LocalFileSystem().get_file_info(pafs.FileSelector(str(path))))


def test_lines_written_and_read(spark, tmp_path):
    d = spark.createDataFrame([(k, f"{k} {k + 1} ") for k in range(500)] + [(500, "")], "q_id long, line string").repartition(7)
    path = tmp_path / "lines"
    for _ in range(2):  # overwritten
        formats.write_answer_lines(d, str(path))
        back = spark.read.format("answer_lines").option("path", str(path)).load().orderBy("file", "n").collect()
        assert [r["ids"] for r in back] == [[k, k + 1] for k in range(500)] + [[]]
    assert all(x.startswith("lines-") for x in files(path))
    none = d.where("false")
    formats.write_answer_lines(none, str(path))
    assert spark.read.format("answer_lines").option("path", str(path)).load().count() == 0


def test_failed_tasks_leave_no_line(spark, tmp_path):
    formats.use(spark)
    path = tmp_path / "lines"
    formats.write_answer_lines(spark.createDataFrame([(1, "7 ")], "q_id long, line string"), str(path))
    before = files(path)
    bad = spark.range(4000, numPartitions=4).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("no"))).otherwise(F.concat(F.col("id").cast("string"), F.lit(" "))).alias("line"))
    with pytest.raises(Exception):  # noqa: B017
        bad.write.format("answer_lines").mode("overwrite").option("path", str(path)).save()
    assert files(path) == before
    # an attempt that was written but not told of does not count
    writer = formats.LineWriter(str(path), False)
    fs = pafs.LocalFileSystem()
    fs.create_dir(f"{path}/_lines-{writer.job}")
    for name in ("0-a", "0-b"):
        with fs.open_output_stream(f"{path}/_lines-{writer.job}/{name}") as out:
            out.write(b"1 2 \n")
    writer.commit([formats.Written(0, f"{path}/_lines-{writer.job}/0-b"), None])
    assert len(files(path)) == len(before) + 1 and not any(x.startswith("_") for x in files(path))


TEXT = "2 3 7 3\n0 0\n4 0\n0 4\n1 1\n3 1\n1 3\n3 3\n2 2\n0 3\n4 4\n1 0\n3 3\n0 4\n"


def test_program(spark, tmp_path, capsys):
    file = tmp_path / "vectors.txt"
    file.write_text(TEXT)
    for form in program.FORMS:
        assert program.main(["7", "3", "3", str(file), "--form", form, "-k", "4"], spark) == 0
        out, err = capsys.readouterr()
        read = sections.read_sections(spark, str(file), "refs_first")
        want = [r["line"] for r in search.answer_lines(program.FORMS[form](read, 4)).orderBy("q_id").collect()]
        assert out.splitlines() == want and "nn 7" in err and "plain_32" in err
    assert program.main(["5", "2", "1", str(file), "--out", str(tmp_path / "out")], spark) == 0
    assert spark.read.format("answer_lines").option("path", str(tmp_path / "out")).load().count() == 1
    for argv, what in ((["7", "3"], "usage"), (["7", "x", "3", str(file)], "usage"), (["8", "3", "3", str(file)], "selected"), (["7", "3", "3", str(tmp_path / "none")], "PATH_NOT_FOUND")):
        assert program.main(argv, spark) == 1
        assert what in capsys.readouterr().err


def test_measures_are_observed(spark, tmp_path):
    s = sections.read_sections
    (tmp_path / "v.txt").write_text(TEXT)
    built = index.build_index(s(spark, str(tmp_path / "v.txt"), "refs_first"))
    found = index.write_measured(built, str(tmp_path / "ix"))
    assert (found["objects"], found["cells"]) == (7, 21) and found["build_ms"] > 0
    assert index.read_measures(spark, str(tmp_path / "ix")).first().asDict() == found
    assert sorted(index.read_index(spark, str(tmp_path / "ix")).collect()) == sorted(built.collect())
