"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up (code generation, landed panels) and is then timed while
all its result rows are computed; rows are consumed in the executors.
"""

from __future__ import annotations

import json
import os
import time

from barline.plans import load
from barline.plans.registry import LANDED, Tables
from barline.session import local_session

HEADLINE = [
    "pit_screen", "pit_momentum", "fundamentals_asof", "price_windows", "sma", "rsi", "macd", "atr_pct", "bollinger", "pivot_readings",
    "technical_snapshot", "equity_metrics", "benchmark_metrics", "metric_suite", "trade_metrics", "trades_by_regime", "pnl_by_source",
    "cluster_counts", "qualified_signals", "disclosure_json", "news_labels", "news_page", "attribution_one_factor", "regime_features",
    "exit_labels", "open_trade_returns", "stress_paths", "sizing_chain", "circuit_breakers", "correlation_filter", "stream_event_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    queries = load()
    times = {}
    # The panels that queries on bars, market and regimes read are landed here, once.
    start = time.perf_counter()
    for panel in LANDED:
        getattr(Tables(spark, sf_dir), panel).count()
    times["landed_panels"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        run = queries[name].run
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
