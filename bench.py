"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is built and run to a no-op sink; staging writes count as part of the query, and are cleared after it. An
untimed pass of the first query starts the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketloom.catalog import load  # noqa: E402
from marketloom.session import clear_staged, local_session  # noqa: E402

HEADLINE = [
    "factor_long_short", "industry_demean_zscore", "qcut_bucket", "residualize_by_date", "daily_ic", "bucket_ic",
    "join_asof_pit_fields", "join_interval_industry_pit", "rolling_median_amount", "turnover_lookback", "technical_indicators",
    "ewm_macd", "nonoverlap_exits", "performance_metrics", "minute_benchmark_daily", "quantile_portfolio_returns",
    "topk_long_only_returns", "combo_search", "walk_forward", "liquidity_diagnostics_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = load()[0]
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    queries[names[0]](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        clear_staged(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
