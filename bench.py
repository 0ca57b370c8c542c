"""Benchmark: headline inspection and repair jobs on the dirtied driver tables.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Prints one JSON line: {"metric", "value", "unit", "queries": {...}, "sf"}.
Each query is forced to completion with the no-op sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verity.operators.inspect import inspect  # noqa: E402
from verity.operators.repair import autofix  # noqa: E402
from verity.operators.score import score_frame  # noqa: E402
from verity.plans import fixtures  # noqa: E402
from verity.session import local_session  # noqa: E402


def run(df):
    df.write.format("noop").mode("overwrite").save()


VIEWS = {}


def prepare(spark, sf):
    """Build the dirtied inputs once (persisted); timed as its own entry."""
    for v in ("dirty_lineitem", "dirty_orders", "dirty_customer", "dirty_staff"):
        df = fixtures.view(spark, sf, v).repartition(spark.sparkContext.defaultParallelism).persist()
        df.count()
        VIEWS[v] = df


def q_inspect(spark, sf, view):
    ins = inspect(VIEWS[view])
    run(score_frame(ins))
    run(ins.cells())


def q_autofix(spark, sf, view):
    res = autofix(VIEWS[view])
    run(res.clean())
    run(res.quarantine())
    run(res.changes())
    res.counts()
    res.unpersist()


QUERIES = {
    "prepare_views": prepare,
    "inspect_score_lineitem": lambda s, sf: q_inspect(s, sf, "dirty_lineitem"),
    "inspect_score_orders": lambda s, sf: q_inspect(s, sf, "dirty_orders"),
    "autofix_orders": lambda s, sf: q_autofix(s, sf, "dirty_orders"),
    "autofix_customer": lambda s, sf: q_autofix(s, sf, "dirty_customer"),
    "autofix_staff": lambda s, sf: q_autofix(s, sf, "dirty_staff"),
    "autofix_lineitem": lambda s, sf: q_autofix(s, sf, "dirty_lineitem"),
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    spark = local_session(cores=cpus, shuffle_partitions=max(2 * cpus, 8), app="verity-bench")
    # warm the JVM and the parquet footers once, untimed
    fixtures.table(spark, sf_dir, "region").count()
    times = {}
    for name, fn in QUERIES.items():
        if only and name not in only and name != "prepare_views":
            continue
        t0 = time.time()
        fn(spark, sf_dir)
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
