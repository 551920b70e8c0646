"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row produced,
nothing collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "nlq_top_customers", "nlq_revenue_by_type_nation", "nlq_customers_no_recent_orders",
    "catalog_tables_base", "profile_distinct_values", "key_discovery_pk", "key_discovery_fk",
    "vec_topk", "vec_topk_per_group", "context_text", "index_upsert", "exact_match_gate",
    "parse_answer", "response_assembly", "text_stats", "sql_layout", "chat_counts",
    "feedback_votes", "graph_components", "graph_betweenness", "keywords_topk", "value_match",
    "flagship_answer",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from tessera.plans.registry import entries
    from tessera.session import get_spark

    spark = get_spark(f"local[{cpus}]", app="tessera-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    ents = entries()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in (only or HEADLINE):
        if name not in ents:
            continue
        t0 = time.time()
        try:
            ents[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as exc:  # noqa: BLE001 - report and continue
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": sf, "cpus": int(cpus)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
