"""Audit the physical plans of all registered queries.

Flags CartesianProduct / BroadcastNestedLoopJoin (pairwise plans) and
reports exchanges, broadcast joins, WindowGroupLimit and Python UDF nodes.
usage: python tools/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FEATURES = ("Exchange", "BroadcastHashJoin", "SortMergeJoin", "WindowGroupLimit", "MapInPandas",
            "ArrowEvalPython", "BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from tessera.plans.registry import entries
    from tessera.session import get_spark

    spark = get_spark("local[8]", shuffle_partitions=8)
    bad = []
    for name, e in entries().items():
        try:
            df = e.fn(spark, sf)
            plan = df._jdf.queryExecution().executedPlan().toString()
        except Exception as exc:  # noqa: BLE001
            print(f"{name}: plan error {exc}")
            continue
        counts = {f: plan.count(f) for f in FEATURES if plan.count(f)}
        flag = counts.get("CartesianProduct", 0) + counts.get("BroadcastNestedLoopJoin", 0)
        if flag:
            bad.append(name)
        print(f"{'PAIRWISE ' if flag else ''}{name}: {counts}")
    print("pairwise plans:", bad or "none")
    spark.stop()


if __name__ == "__main__":
    main()
