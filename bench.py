"""Wall-clock seconds of the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads. Each query is built and
run from the tables, nothing is shared between queries, and its whole result
is produced. An untimed pass over the smallest tables warms the engine up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import REGISTRY, runner  # noqa: E402
from tradelanes.session import build_session  # noqa: E402

HEADLINES = [
    # ingestion and hazard
    "extract_corridors",
    "build_notifications",
    "hazard_summary",
    "run_hazard",
    # dependency, consumption, trade flow
    "corridor_dependency",
    "consumption_rank_score",
    "volume_anomaly",
    "unit_value_zscore",
    "mirror_discrepancy",
    "trade_anomalies",
    # network and score
    "origin_risk_propagation",
    "attention_exposure",
    "run_scoring",
    "corridor_full_profile",
    # report
    "top_routes",
    "yoy_by_route",
    "reporter_partner_matrix",
    "partners_per_reporter",
    "route_commodity_breakdown",
    "top_commodities_overall",
    "market_concentration",
    "dual_concentration",
    "validate_trade",
    "describe_trade",
    # queries over the metrics
    "filter_corridors",
    "top_corridors",
    "exposure_profile",
    "merge_trade_files",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINES
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
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        for key in wanted:
            runner(REGISTRY[key])(spark, small).write.format("noop").mode("overwrite").save()
    seconds = {}
    for key in wanted:
        start = time.perf_counter()
        runner(REGISTRY[key])(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
        print(f"{key} {seconds[key]}", file=sys.stderr)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
