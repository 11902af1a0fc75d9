"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomstat.plans.registry import QUERIES, load_all, sources  # noqa: E402
from loomstat.session import local_session  # noqa: E402

HEADLINE = [
    "M3_marts_cohort_analysis", "M1_marts_platform_kpis", "M4_marts_oficina_scoring", "M5_marts_empresa_clv",
    "M8_marts_geographic_analysis", "I1_int_pedidos_enriched", "I2_int_oficina_performance",
    "I6_int_daily_platform_snapshot", "M6_marts_match_quality", "M7_marts_revenue_analytics",
    "C1_funnel_summary", "K4_cohort_summary", "R1_compute_scores", "G2_recommendations", "G3_total", "G4_supply_demand_gaps",
    "V1_rfm_summary", "Q2_referential_integrity", "T4_daily_activity_stream",
    "I5_int_match_pairs", "M2_marts_customer_journey", "Q6_schema_profile", "G1_score_bids", "V2_fit_bgnbd", "V3_fit_gamma_gamma",
    "V4_predict_clv_fixed", "V5_expected_purchases_fixed", "V7_segment_by_clv_fixed", "T1_live_workshop_scores",
    "T5_user_sessions_stream", "T6_dedup_events_stream", "S2_copy_text_roundtrip",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    t0 = time.time()
    sources(spark, sf_dir).publish_all()  # S4: write the source tables once (shared by every query below)
    times["S4_publish_sources"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()  # runs the whole plan on the JVM, no transfer
        times[name] = round(time.time() - t0, 3)
        rows[name] = df.count()  # untimed
    total = round(sum(times.values()), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_wall_time_headline_queries", "value": total, "unit": "sec",
                      "queries": times, "rows_out": rows, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
