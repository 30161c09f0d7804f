"""Benchmark the registered queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The test tables are one row group each, which one task reads; tables of a cluster have
many. So every table is first stored again in as many files as there are cores, and
the queries run over those. Each query runs to completion through the ``noop`` sink (no
driver collect). The headline queries come first: one warm-up run, then ``BENCH_REPEAT``
timed runs (median reported). All others run once, as long as ``BENCH_SECONDS`` have not
gone by. The value is the headline queries' total. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanlake.plans.registry import queries  # noqa: E402
from spanlake.session import local_session, scratch_path  # noqa: E402
from spanlake.sources.tables import TABLES  # noqa: E402

HEADLINE = [
    "retrieved_context",      # R1+R3+R5+R7+R8: questions -> BM25 top-10 -> context
    "bm25_multifield",        # R4
    "clean_qa_shift_answer",  # T1-T3
    "train_features",         # W1-W8 train windows with labels
    "eval_features",          # W1-W8 eval windows
    "nbest_probability",      # D1-D9
    "final_answer_null",      # D7-D10
    "ensemble_majority",      # V1-V4 over three decoders
    "evaluate_all",           # E1-E3
    "kfold_parts",            # K2-K3
]


def laid_out(spark, sf_dir: str, files: int) -> str:
    """The tables of ``sf_dir``, stored again in ``files`` files each."""
    out = scratch_path(spark, "bench-tables")
    for t in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df.repartition(files).write.parquet(f"{out}/{t}.parquet")
    return out


def run_once(spark, fn, sf_dir: str) -> float:
    spark.catalog.clearCache()  # each run builds its own cached intermediates
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    cores = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, cores)
    qs = queries()
    others = [n for n in qs if n not in HEADLINE]
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + others)).split(",") if n]
    limit = time.perf_counter() + float(os.environ.get("BENCH_SECONDS", "480"))
    tables = laid_out(spark, sf_dir, cores)
    times = {}
    for name in names:
        if name in HEADLINE:
            run_once(spark, qs[name], tables)  # warm-up
        elif time.perf_counter() > limit:
            print(f"# {name}: not run, out of time", file=sys.stderr, flush=True)
            continue
        runs = [run_once(spark, qs[name], tables) for _ in range(repeat if name in HEADLINE else 1)]
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    total = sum(t for n, t in times.items() if n in HEADLINE)
    out = {"metric": "headline_total_sec", "value": round(total, 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
