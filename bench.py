"""Benchmark: median seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlight import build_session
from ledgerlight.plans.registered import REGISTRY

HEADLINE = (
    "customer_profile", "counterparty_profile", "amount_features", "velocity_features", "behaviour_deviation",
    "device_features", "counterparty_features", "rule_hits", "statistical_findings", "rule_hits_counterparty",
    "risk_fusion", "alert_topk", "fk_report", "clean_strings", "impute_median_mode", "enriched_join",
    "relationship_degree", "smurfing_48h", "chain_3hop", "cycle_4", "mule_pass_through", "amount_summary",
    "intent_scores", "entity_extract", "anomaly_findings",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "ledgerlight-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        begin = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin

    once("customer_profile")  # start the engine before timing
    seconds = {name: round(statistics.median(once(name) for _ in range(runs)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder).removeprefix("sf"), "cpus": int(cpus),
                "spark": spark.version, "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
