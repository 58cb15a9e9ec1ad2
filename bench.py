"""Time the headline queries: ``BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py [name ...]``.

Prints one JSON line: per query the median of warm runs, after one cold run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from riskloom.plans.queries import QUERIES  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = [
    "normalize_events",
    "telemetry_dead_letter",
    "dedup_events",
    "account_enrichment",
    "historical_context",
    "risk_indicators",
    "risk_scores",
    "risk_alerts",
    "secondary_risk_alerts",
    "inactivity_reset_alerts",
    "threshold_clear_alerts",
    "ip_velocity_alerts",
    "ato_sequence",
    "incidents",
    "incident_transitions",
    "case_metrics",
    "transfer_edges",
    "circular_rings",
    "shared_infrastructure",
    "ego_network",
    "employee_mass_access",
    "event_rate_5m",
    "index_documents",
    "stream_incidents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    warm = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "riskloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        runs = []
        for _ in range(warm + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total seconds, headline queries, median of warm runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
