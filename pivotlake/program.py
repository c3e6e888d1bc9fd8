"""The search as a program for spark-submit:

    spark-submit pivotlake/program.py OBJECTS REFERENCES QUERIES FILE [options]

The numbers select prefixes of the file's sections. Fewer arguments, numbers that are none, a
missing or short file and a selection beyond a section end with a message on stderr and exit
code 1. Parameters, sizes and times go to stderr, answer lines to stdout or into ``--out``.
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

if __package__ in (None, ""):  # started as a file
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from pivotlake.operators import index, search
from pivotlake.operators.vectors import VectorSet
from pivotlake.sources import formats, sections

FORMS = {
    "exact": lambda s, k: search.exact_topk(s, k).withColumnRenamed("dist", "score"),
    "footrule": search.footrule_topk_bulk,
    "late": lambda s, k: search.topk_late_ties(search.array_scores(s), k),
    "permutation": search.permutation_topk,
}


class Usage(Exception):
    pass


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise Usage(f"{self.format_usage()}{message}")


def parse(argv: list[str]) -> argparse.Namespace:
    p = Parser(prog="program.py", add_help=False)
    for name in ("objects", "references", "queries"):
        p.add_argument(name, type=int)
    p.add_argument("file")
    p.add_argument("--form", choices=FORMS, default="footrule")
    p.add_argument("--layout", choices=sections.LAYOUTS, default="refs_first")
    p.add_argument("-k", type=int, default=10)
    p.add_argument("--out", help="folder for the answer lines")
    return p.parse_args(argv)


def answer(spark: SparkSession, a: argparse.Namespace) -> tuple[VectorSet, DataFrame]:
    read = sections.read_sections(spark, a.file, a.layout, a.objects, a.references, a.queries)
    s = VectorSet.of(read.objects, read.pivots, read.queries)
    return s, search.answer_lines(FORMS[a.form](s, a.k))


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    say = lambda *x: print(*x, file=sys.stderr)
    try:
        a = parse(argv)
    except Usage as e:
        say(e)
        return 1
    spark = spark or SparkSession.builder.appName("pivotlake").getOrCreate()
    began = time.perf_counter()
    try:
        s, lines = answer(spark, a)
    except (ValueError, AnalysisException) as e:
        say(str(e).splitlines()[0])
        return 1
    for name, value in index.parameters(s).first().asDict().items():
        say(name, value)
    for r in index.size_report(s).collect():
        say(r["coding"], f"{r['mib']:.6f} MiB")
    if a.out:
        formats.write_answer_lines(lines, a.out)
    else:
        for r in lines.orderBy("q_id").toLocalIterator():
            print(r["line"])
    say("ms", round(1000 * (time.perf_counter() - began)))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
