"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = ("A02_time_bins", "A03_candidate_features", "W04_merge_points", "W06_segments_from_boundaries",
            "J01_assign_closed", "J02_assign_half_open_last_closed", "J03_assign_end_fallback", "J06_window_join",
            "J09_match_points", "J14_match_intervals", "J25_jaccard_pairs", "A08_segment_profile", "A24_average_precision",
            "A25_sweep_thresholds", "A51_quantiles", "W11_fold_phases", "P11_json_flatten", "T07_stratified_sample")


def main() -> None:
    from tracewright.catalog import registry
    from tracewright.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    entries = registry()
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()  # also warms the engine up
    entries["A02_time_bins"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus), "spark": spark.version, "events": rows,
                      "events_per_sec": {q: round(rows / times[q]) for q in ("A03_candidate_features", "J01_assign_closed",
                                                                             "J02_assign_half_open_last_closed")}}))
    spark.stop()


if __name__ == "__main__":
    main()
