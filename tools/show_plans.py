"""Print the physical plans of the key jobs (explain "formatted").

usage: python tools/show_plans.py [sf_dir]
Shows: the shared profile aggregate, the hashed duplicate count, the top-100
cells window, the fused repair stage after the last barrier, the mode
aggregate and the history retention window.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verity.operators.history import entries_from_events, retain  # noqa: E402
from verity.operators.inspect import _k, duplicate_candidates, inspect  # noqa: E402
from verity.operators.repair import autofix  # noqa: E402
from verity.plans import fixtures  # noqa: E402
from verity.session import local_session  # noqa: E402


def show(title, df):
    print(f"\n===== {title} =====", flush=True)
    df.explain("formatted")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    df = fixtures.view(spark, sf, "dirty_orders")
    ins = inspect(df)
    cols = ins.columns
    show("profile aggregate (one job, all columns, all checks)",
         ins.ctx.df.agg(*[F.count(F.col(c)).alias(_k(c, "nn")) for c in cols]))
    cand = duplicate_candidates(ins.ctx.df, cols)
    show("duplicate count: hash pre-filter, then exact group-by of candidates",
         cand.groupBy(*cols).count().agg(F.sum(F.col("count") - 1)))
    show("affected cells: first 100 per issue (WindowGroupLimit)", ins.cells())
    res = autofix(df)
    show("repair: clean rows from the persisted final frame", res.clean())
    show("change log with dense positions among clean rows", res.changes())
    ev = fixtures.table(spark, sf, "events")
    show("history retention: newest 50 per user (WindowGroupLimit)", retain(entries_from_events(ev)))


if __name__ == "__main__":
    main()
