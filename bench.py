"""Benchmark: headline queries end to end from the driver tables.

Runs every headline query at ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]``, executes each result fully (noop sink), and prints ONE
JSON line: per-query median seconds, their sum as ``value``, and what each
query's jobs did (executed exchanges, MB shuffled and written, jobs started while
the query is built included). ``BENCH_BATCH=1`` also times two
full batches through every layer (``batch_runs``).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strata.plans.registry import QUERIES  # noqa: E402
from strata.session import build_session  # noqa: E402

HEADLINE = [
    "q41_top_trade_groups", "q42_brand_month", "q43_brand_region_ranks", "q44_sql_region_trade_group",
    "q45_region_totals", "q45_top_brands", "q45_executive_summary",
    "c5_merge_stats", "c3_latest_per_key", "d3_d4_sales_rules", "d11_dq_metrics",
    "m6_fact_sales", "a1_business_metrics", "b14_gold_sales_rules",
]


def executed(spark, group: str) -> dict:
    """What the jobs of a group did, building the query included: jobs, stages
    that wrote a shuffle (executed exchanges), MB shuffled, MB written."""
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()
    jobs = sc.statusTracker().getJobIdsForGroup(group)
    stages = {s for j in jobs if (info := sc.statusTracker().getJobInfo(j)) for s in info.stageIds}
    out = {"jobs": len(jobs), "exchanges": 0, "shuffle_mb": 0.0, "written_mb": 0.0}
    for s in stages:
        if sc.statusTracker().getStageInfo(s) is None:
            continue
        data = store.lastStageAttempt(s)
        out["exchanges"] += data.shuffleWriteBytes() > 0
        out["shuffle_mb"] += data.shuffleWriteBytes() / 1e6
        out["written_mb"] += data.outputBytes() / 1e6
    return {k: round(v, 2) for k, v in out.items()}


def time_batches(spark, sf_dir: str) -> dict:
    """Two batches through every layer (bronze history, DQ, merge, gold,
    star, marts) into a store under the shared checkpoint folder."""
    import uuid

    from strata.plans.batch import run_batch
    from strata.plans.domain import (BATCH_ID, BATCH_TS, PROFILE, SECOND_BATCH_ID, SECOND_BATCH_TS,
                                     DriverDomain)
    from strata.session import ensure_checkpoint_dir
    from strata.sources import driver as D
    from strata.sources.tables import TableStore

    store = TableStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-lake-{uuid.uuid4().hex}")
    d = DriverDomain(spark, sf_dir)
    first = D.sales_landing(spark, sf_dir, returns_booked=False, date_before=D.FIRST_EXTRACT_END)
    second = D.sales_landing(spark, sf_dir, returns_booked=True, date_from=D.SECOND_EXTRACT_START)
    out = {}
    for label, land, bid, bts in (("first_batch", first, BATCH_ID, BATCH_TS),
                                  ("second_batch", second, SECOND_BATCH_ID, SECOND_BATCH_TS)):
        t0 = time.perf_counter()
        stats = run_batch(spark, store, land, d.channel_landing, PROFILE, bid, bts)
        out[label] = round(time.perf_counter() - t0, 3)
        out[f"{label}_rows"] = {k: v for k, v in stats.items() if k in ("bronze_rows", "inserted", "updated",
                                                                      "unchanged", "kept", "silver_rows")}
    return out


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", "strata-bench", shuffle_partitions=max(cpus * 2, 8))
    names = [q for q in (sys.argv[1:] or HEADLINE) if q in QUERIES]
    # warm-up: JVM code paths, file listing caches
    QUERIES[names[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times, work = {}, {}
    for name in names:
        ts = []
        for i in range(runs):
            spark.sparkContext.setJobGroup(f"{name}-{i}", name)
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(ts), 3)
        work[name] = executed(spark, f"{name}-{runs - 1}")
    batches = time_batches(spark, sf_dir) if os.environ.get("BENCH_BATCH", "0") == "1" else None
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "runs": runs, "executed": work, "batch_runs": batches}))
    spark.stop()


if __name__ == "__main__":
    main()
