"""Physical-plan review of registered queries.

    python scripts/explain.py [--formatted] [--summary] [sf_dir] [name ...]

Per query it reports how often the fact table is scanned and which
exchanges the initial physical plan has (AQE may later coalesce
partitions or turn a sort-merge join into a broadcast, never the reverse).
``--summary`` prints a markdown table (PLANS.md is generated with it).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tally.plans import queries  # noqa: E402
from tally.session import get_session  # noqa: E402

KINDS = [("hash", r"Exchange hashpartitioning"), ("range", r"Exchange rangepartitioning"),
         ("single", r"Exchange SinglePartition"), ("roundrobin", r"Exchange RoundRobinPartitioning"),
         ("broadcast", r"BroadcastExchange"), ("smj", r"SortMergeJoin"), ("window", r"\bWindow \["),
         ("python", r"MapInPandas|PythonMapInArrow|ArrowEvalPython"), ("subquery", r"Subquery")]


def summarize(plan: str) -> dict:
    out = {"lineitem_scans": plan.count("lineitem.parquet")}
    for k, pat in KINDS:
        out[k] = len(re.findall(pat, plan))
    return out


def main():
    args = sys.argv[1:]
    formatted = "--formatted" in args
    summary = "--summary" in args
    args = [a for a in args if not a.startswith("--")]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8)
    qs = queries.build()
    rows = []
    for name in args or sorted(qs):
        df = qs[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        rows.append((name, s))
        if not summary:
            print(f"== {name}: lineitem scans in initial plan: {s['lineitem_scans']}  {s}")
        if formatted:
            df.explain("formatted")
    if summary:
        keys = list(rows[0][1])
        print("| query | " + " | ".join(keys) + " |")
        print("|---|" + "---|" * len(keys))
        for name, s in rows:
            print(f"| {name} | " + " | ".join(str(s[k]) for k in keys) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
