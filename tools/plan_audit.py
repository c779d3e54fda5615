"""Summarise the physical plan of every query of the library itself: shuffles,
broadcasts, forbidden joins, Python stages, and the columns each scan reads.

    python tools/plan_audit.py [--sf-dir DIR] > PLANS.md
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def audit(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: \w+\(\d+ paths?\)\[[^\]]*/([a-z]+)\.parquet", plan)
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan)),
        "broadcasts": plan.count("BroadcastExchange"),
        "nested_loop_or_cartesian": plan.count("BroadcastNestedLoopJoin") + plan.count("CartesianProduct"),
        "python": sorted(set(re.findall(r"(MapInPandas|MapInArrow|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas)", plan))),
        "scans": sorted({f"{t}({cols.count(',') + 1 if cols else 0} cols)" for cols, t in scans}),
        "pushed_filters": sorted(set(re.findall(r"PushedFilters: \[([^\]]+)\]", plan))),
    }


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    a = ap.parse_args(argv)
    from claimflow.plans import registry
    from claimflow.session import get_spark
    registry.load_all()
    spark = get_spark("local[8]", shuffle_partitions=16)
    print("| query | shuffles | broadcasts | NLJ/cartesian | python | scans (columns read) |")
    print("|---|---|---|---|---|---|")
    for name, fn in sorted(registry.QUERIES.items()):
        r = audit(fn(spark, a.sf_dir))
        print(f"| {name} | {r['shuffles']} | {r['broadcasts']} | {r['nested_loop_or_cartesian']} | "
              f"{' '.join(r['python']) or '-'} | {', '.join(r['scans'])} |", flush=True)


if __name__ == "__main__":
    main()
