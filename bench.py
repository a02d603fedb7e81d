"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query runs once to warm up and then twice into the ``noop`` sink; the faster time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docketry import build_session  # noqa: E402
from docketry.plans import registry  # noqa: E402

HEADLINE = [
    "session_rollup",
    "dashboard_by_scope",
    "history_window",
    "used_sources",
    "source_breakdown",
    "citation_links",
    "document_search",
    "resolved_labels",
    "upserted_and_capped",
    "file_last_wins",
    "reconciled_uploads",
    "upload_summary",
    "folded_turns",
    "debounced_notes",
    "changed_notes",
    "ready_templates",
    "document_blocks",
    "validation_prompts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        best = None
        for i in range(3):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two warm runs, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
