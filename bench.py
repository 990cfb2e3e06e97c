"""Time headline queries from the raw tables.

Every query starts from an empty warehouse, so its time includes all the marts
it needs. `pipeline` builds the whole warehouse once, sharing marts.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import catalogue
from ledgerloom.plans.warehouse import MARTS

HEADLINE = [
    "merchant_month", "merchant_month_dense", "merchant_churn_status", "cohort_retention",
    "network_health_monthly", "incident_culprit_ranking", "failure_reason_mix", "merchant_features",
    "exposure_vs_churn", "revenue_at_risk", "fixed_window_sweep", "forecast_errors",
]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    queries = catalogue.queries()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        catalogue.forget()
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s}{times[name]:9.3f}s", file=sys.stderr, flush=True)

    def pipeline() -> None:
        w = catalogue.warehouse(spark, folder)
        for name, mart in MARTS.items():
            df = w[name]
            if not mart.stage and mart.step != "schema":
                drain(df)

    # One small pass first, so class loading is not billed to the first query.
    drain(queries["analysis_window"](spark, folder))
    if not sys.argv[1:]:
        timed("pipeline", pipeline)
    for name in names:
        timed(name, lambda: drain(queries[name](spark, folder)))
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
