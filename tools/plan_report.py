"""Physical-plan shape of every registered query (markdown table).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts shuffles (Exchange), broadcasts, window operators, Python stages and
the columns each Parquet scan reads, from the executed plan (AQE final
plan after one run)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from webtide.plans.registry import all_oracle_sql, all_queries
    from webtide.session import local_session

    spark = local_session(8)
    oracle = set(all_oracle_sql())
    print("| query | shuffles | broadcasts | windows | python | scans read | oracle |")
    print("| --- | --- | --- | --- | --- | --- | --- |")
    for name, q in sorted(all_queries().items()):
        df = q(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan))
        bcast = plan.count("BroadcastExchange")
        windows = len(re.findall(r"\bWindow\b", plan))
        py = len(re.findall(r"MapInArrow|MapInPandas|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", plan))
        reads = sorted(set(re.findall(r"ReadSchema: struct<([^>]*)>", plan)))
        reads = "; ".join(",".join(f.split(":")[0] for f in r.split(",")) for r in reads) or "(checkpoint / stream sink)"
        print(f"| {name} | {shuffles} | {bcast} | {windows} | {py} | {reads} | {'D' if name in oracle else 'R'} |")


if __name__ == "__main__":
    main()
