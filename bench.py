"""Headline-query benchmark.

``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``:
one warm-up run per query, then ``$BENCH_REPS`` (default 3) timed runs (time to
collected rows, including the fixture joins; nothing is cached); the per-query
value is the median run. Prints one JSON line.

The ``store`` section times the production path separately (not part of
``value``): the transactions are written once to the month-partitioned
store (``write_sec``), then the same nine reports run on it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tally.operators.account import account_summary  # noqa: E402
from tally.operators.cash_flow import cash_flow  # noqa: E402
from tally.operators.category import category_analysis  # noqa: E402
from tally.operators.merchant import merchant_analysis  # noqa: E402
from tally.operators.pnl import profit_and_loss  # noqa: E402
from tally.operators.summary import summary_statistics  # noqa: E402
from tally.operators.trend import trend  # noqa: E402
from tally.plans import params as P  # noqa: E402
from tally.session import get_session, scratch_dir  # noqa: E402
from tally.sources.fixtures import transactions  # noqa: E402
from tally.sources.store import read_store, write_store  # noqa: E402

HEADLINE = {
    "expenses_by_category": lambda t: profit_and_loss(t).sections["expenses_by_category"],
    "category_statistics": lambda t: category_analysis(t).details,
    "account_summary": lambda t: account_summary(t).details,
    "summary_exact_median": lambda t: summary_statistics(t).header,
    "cash_flow_monthly": lambda t: cash_flow(t, grouping="monthly").details,
    "cash_flow_weekly": lambda t: cash_flow(t, grouping="weekly").details,
    "top_category_monthly": lambda t: trend(t, grouping="monthly").details,
    "top_category_weekly": lambda t: trend(t, grouping="weekly").details,
    "merchant_top20_mode": lambda t: merchant_analysis(t, top_n=P.MERCHANT_TOP_N).details,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    store_reps = int(os.environ.get("BENCH_STORE_REPS", "3"))
    spark = get_session(f"local[{cpus}]", app_name="tally-bench", shuffle_partitions=int(cpus))
    def timed(source, reps):
        times, rows = {}, {}
        for name, fn in HEADLINE.items():
            fn(source()).collect()  # warm-up
            runs = []
            for _ in range(reps):
                t0 = time.perf_counter()
                out = fn(source()).collect()
                runs.append(time.perf_counter() - t0)
            times[name] = round(median(runs), 3)
            rows[name] = len(out)
        return times, rows

    times, rows = timed(lambda: transactions(spark, sf_dir), reps)
    t0 = time.perf_counter()
    path = write_store(transactions(spark, sf_dir), scratch_dir(spark, "bench-store"))
    write_sec = time.perf_counter() - t0
    store_times, _ = timed(lambda: read_store(spark, path), store_reps)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "rows": rows, "sf": sf,
                      "cpus": int(cpus),
                      "store": {"write_sec": round(write_sec, 3), "queries": store_times,
                                "total": round(sum(store_times.values()), 3)}}))
    spark.stop()


if __name__ == "__main__":
    main()
