"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores; BENCH_QUERIES, a comma list, restricts the run.
"""

from __future__ import annotations

import json
import os
import time

from parcelspark.plans.registry import QUERIES
from parcelspark.session import local_session

HEADLINE = [
    "j1_project_nearby_sales", "j2_p8_impact_zone", "j3_p7_road_impact", "m1_m2_m3_fit_by_project_type",
    "q1_project_impact_report", "j8_j9_aligned_months", "w8_lead_lag", "q2_road_report", "g7_band_prices",
    "q3_halo_report", "j4_competitor_counts", "j4_g2_population_around", "j5_g13_nearest_road_degree",
    "g6_sales_growth", "q4_p6_feature_table", "l5_q7_similar_regions", "l4_embedding_neighbours",
    "p4_q8_similar_stores", "m10_m11_forecast_with_catalysts", "m12_g14_backtest_summary", "m13_l8_rationales",
    "j12_store_full_profile", "s1_s2_s3_sales_feed", "k1_merged_prices",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "parcelspark-bench")
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = chosen.split(",") if chosen else HEADLINE
    QUERIES["g9_yearly_traffic"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
