"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  directory of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names instead of the headline set
BENCH_DUCKDB  1 adds DuckDB's time for the same SQL (stderr only)
"""

from __future__ import annotations

import json
import os
import sys
import time

from clickloom import catalog
from clickloom.session import local_session

HEADLINE = (
    "join_wide_impression", "join_semi_users", "join_time_bucket", "agg_smoothed_rate", "agg_key_gaps",
    "agg_key_profile_all", "agg_pageview_profile", "agg_summary", "agg_doc_weighted_score", "win_group_size",
    "win_gap_to_previous", "win_leader_values", "win_topk_pivot", "win_rank_in_display", "ord_mixed", "spl_train_valid",
    "spl_random_blocks", "spl_kfold", "ev_ap_single", "ev_map12", "ev_map_by_ranges", "ev_baseline_grid",
    "ev_ranked_list", "ev_global_ap", "fea_doc_types", "fea_insert_key_profiles", "fea_sequences",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    catalog.load()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    catalog.QUERIES["join_events"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    if os.environ.get("BENCH_DUCKDB"):
        from tests.compare import connect

        con = connect(sf_dir)
        con.execute(f"SET threads = {cpus}")
        for name in names:
            if name in catalog.ORACLES:
                start = time.perf_counter()
                con.execute(f"CREATE OR REPLACE TEMP TABLE bench_out AS {catalog.ORACLES[name]}")
                print(f"duckdb {name} {time.perf_counter() - start:.3f} / {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
