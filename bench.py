"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tessera.plans import catalogue
from tessera.session import local_session

HEADLINE = [
    "equity_gap_top30", "access_dignity", "rank_closest", "rank_with_intent", "open_status_at", "nearest_station_k3", "transit_mode_choice", "geocode_tiers",
    "dedup_pairs_fuzzy", "dedup_components", "dedup_backfill", "worst_alert_per_cell", "event_summary", "events_sessions", "completeness_report", "contact_extract",
    "page_records", "cache_hit_miss", "lineitem_load", "orders_by_area",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus, max(8, cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = {n: catalogue.QUERIES[n] for n in HEADLINE}
    try:
        from tessera.llm import catalogue as llm

        queries |= llm.QUERIES
    except ModuleNotFoundError as missing:
        if missing.name != "tessera.llm":  # anything else that is missing is a fault
            raise
    spark.range(1).count()
    took = {}
    for name, query in queries.items():
        began = time.time()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
