"""Time headline queries; prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidentia.plans import catalog  # noqa: E402
from evidentia.plans.inputs import READ_PARTITIONS  # noqa: E402
from evidentia.session import build_session  # noqa: E402

HEADLINE = (
    "v13_transitions",
    "v5_contradiction",
    "v6_consensus",
    "v15_version_audit",
    "v16_review_items",
    "d7_ledger_append",
    "d2_resolve_papers",
    "e5_segment_units",
    "e13_build_sections",
    "e15_persist_evidence",
    "g7_link_claims",
    "g8_neighbors",
    "q4_fts",
    "q7_hybrid_search",
    "c1_topic_landscape",
    "c5_contradiction_map",
    "a13_provider_observations",
    "a16_eta",
    "w6_transition_audit",
    "st1_provider_health",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            READ_PARTITIONS: cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["a11_queue_counts"](spark, folder).collect()  # start the engine
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cpus,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
