"""Headline timings: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_bar_features", "i02_atr", "i17_adx", "i23_add_features", "w10_smart_lags", "t18_set_targets", "x02_class_counts",
    "a03_one_hot_sums", "a05_rich_buckets", "j01_bars_with_events", "j06_daily_onto_hourly", "l15_update_ranges",
    "w07_lagged_target_stats", "v01_quarter_blocks", "m07_binary_metrics", "m05_interval_metrics", "x16_ngrams",
    "l12_daily_digests", "s08_upsert_prices", "st1_streamed_bars",
]


def main() -> None:
    from squallbars.catalog import QUERIES
    from squallbars.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = build_session("bench", f"local[{cpus}]", int(cpus), spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
