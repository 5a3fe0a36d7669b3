"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line.

Stage timings mirror the reference's published stage times: reshape (bank
transactions -> donations), label (features + rules + noisy labels), train
(random forest + isolation forest), plus the main report / screening / window
queries. Every query is fully executed with the no-op sink (no collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from giftrisk.plans import catalog  # noqa: E402
from giftrisk.plans.pipeline import Pipeline  # noqa: E402
from giftrisk.session import get_spark  # noqa: E402

HEADLINE = ["triage_queue", "rule_lift", "model_comparison", "rate_by_category_sets", "donor_deviation",
            "ip_velocity_24h", "reversal_interval_join", "donor_running_history", "sanctions_fuzzy_hits",
            "threshold_sweep", "rf_scores", "risk_table", "two_step_scoring", "tree_shap", "stream_velocity"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, extra={"spark.driver.memory": "16g"})
    spark.range(1000).selectExpr("md5(cast(id as string))").count()  # start executor threads before timing
    qs = catalog.all_queries()
    times = {}
    p = Pipeline.get(spark, sf_dir)
    t = time.time()
    p.donations()
    times["stage_reshape"] = time.time() - t
    t = time.time()
    p.anchors()
    p.labeled()
    times["stage_label"] = time.time() - t
    for name in HEADLINE:
        t = time.time()
        run(qs[name](spark, sf_dir))
        times[name] = time.time() - t
    total = sum(times.values())
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(total, 2), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()}, "sf": sf}))


if __name__ == "__main__":
    main()
