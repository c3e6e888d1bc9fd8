"""Headline queries, timed: prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default all) choose data and cores. Each
query runs once to warm up (code generation, Python workers) and then three times for the clock,
from the scan to the collected answers; the median counts. ``index_build`` and ``index_search`` are the two halves
of a search over a stored index.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

from pivotlake.functions.shared import delete, fresh_path
from pivotlake.operators import codecs, index, permutations, search
from pivotlake.operators.vectors import split_embeddings
from pivotlake.plans import registry

N_PIVOTS, K, K_EXACT = 64, 10, 100


def headline(spark: SparkSession, sf_dir: str, stored: str) -> dict:
    s = split_embeddings(spark, sf_dir, N_PIVOTS)
    positions = lambda: permutations.array_to_long(index.build_index(s))
    return {
        "index_build": lambda: index.write_index(index.build_index(s), stored),
        "index_search": lambda: search.index_topk(index.read_index(spark, stored), *search.ranked_queries(s), K),
        "footrule_topk_bulk": lambda: search.footrule_topk_bulk(s, K),
        "footrule_topk_array": lambda: search.footrule_topk_array(s, K),
        "footrule_topk_long": lambda: search.footrule_topk(s, K),
        "permutation_topk": lambda: search.permutation_topk(s, K),
        "footrule_topk_points": lambda: registry.footrule_topk_points(spark, sf_dir),
        "exact_topk_l2": lambda: search.exact_topk(s, K_EXACT, "l2"),
        "delta_pos_size": lambda: codecs.delta_sizes_of(index.build_index(s), N_PIVOTS, "pos"),
        "delta_gap_size": lambda: codecs.delta_sizes_of(index.build_index(s), N_PIVOTS, "gap"),
        "s9_words_pos": lambda: codecs.s9_words(positions(), N_PIVOTS, "pos"),
    }


def calibration() -> float:
    """Milliseconds that this machine takes for a fixed loop, the median of some: figures of
    different machines or hours compare by it."""
    found = []
    for _ in range(21):
        began = time.perf_counter()
        sum(range(1_000_000))
        found.append(time.perf_counter() - began)
    return round(1000 * sorted(found)[10], 2)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    stored = fresh_path(spark, "bench-index")
    for name, query in headline(spark, sf_dir, stored).items():
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            answers = query()
            if answers is not None:
                answers.collect()
            runs.append(time.perf_counter() - began)
        took[name] = round(sorted(runs[1:])[1], 3)
    delete(spark, stored)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf"), "calibration": calibration()}))


if __name__ == "__main__":
    main()
