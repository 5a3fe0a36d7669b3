"""Summarise the physical plans of the headline queries: scans (read schema,
pushed filters), shuffles, join strategies, windows, whole-stage codegen.

    python tools/explain_plans.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from giftrisk.plans import catalog  # noqa: E402
from giftrisk.plans.pipeline import Pipeline  # noqa: E402
from giftrisk.session import get_spark  # noqa: E402

HEADLINE = ["triage_queue", "rule_lift", "rate_by_category_sets", "donor_deviation", "ip_velocity_24h",
            "reversal_interval_join", "donor_running_history", "refund_interval_join", "sanctions_fuzzy_hits",
            "threshold_sweep", "model_comparison", "corr_with_label"]


def summarise(name: str, df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()  # so the adaptive plan is final
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    out = [f"## {name}", ""]
    tree = plan.split("\n\n")[0]
    if "== Final Plan ==" in tree:  # adaptive plan: keep the final tree only
        tree = tree.split("== Final Plan ==")[1].split("== Initial Plan ==")[0]
    nodes = re.findall(r"^[\s:+\-]*(\*?)\s*([A-Za-z]+)", tree, flags=re.M)
    names = [n for _, n in nodes]
    ops = {
        "shuffle exchanges": names.count("Exchange"),
        "broadcast exchanges": names.count("BroadcastExchange"),
        "broadcast hash joins": names.count("BroadcastHashJoin"),
        "sort-merge joins": names.count("SortMergeJoin"),
        "shuffled hash joins": names.count("ShuffledHashJoin"),
        "nested-loop / cartesian joins": names.count("BroadcastNestedLoopJoin") + names.count("CartesianProduct"),
        "window operators": names.count("Window"),
        "python (pandas) operators": sum(names.count(x) for x in ("ArrowEvalPython", "FlatMapGroupsInPandas",
                                                                 "MapInPandas")),
    }
    out += [f"- {k}: {v}" for k, v in ops.items()]
    for block in re.split(r"\n\(\d+\) ", plan):
        if not block.startswith("Scan parquet"):
            continue
        m_schema = re.search(r"ReadSchema: (struct<[^\n]*>)", block)
        m_filt = re.search(r"PushedFilters: (\[[^\n]*\])", block)
        m_loc = re.search(r"Location: \w+ \[([^\]]*)\]", block)
        loc = m_loc.group(1).split(",")[0].rstrip("/").split("/")[-1] if m_loc else "?"
        loc = re.sub(r"-[0-9a-f]{8}$", "", loc)
        out.append(f"- scan `{loc}`: read schema `{m_schema.group(1) if m_schema else '?'}`, pushed filters "
                   f"`{m_filt.group(1) if m_filt else '[]'}`")
    out.append("")
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", 8, extra={"spark.sql.debug.maxToStringFields": "1000"})
    qs = catalog.all_queries()
    Pipeline.get(spark, sf_dir).labeled()
    lines = ["# Physical plan summary of the headline queries", "",
             f"Input `{sf_dir}`; the pipeline stages (donations, scored, noisy, labeled, entities) are "
             "materialised Parquet in the shared checkpoint folder, so reports start from those scans.", ""]
    for name in HEADLINE:
        lines += summarise(name, qs[name](spark, sf_dir))
    print("\n".join(lines))


if __name__ == "__main__":
    main()
