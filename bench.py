"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores. Derived
input tables are written before the clock starts (``prepare``); every query then
runs three times into the no-op sink and the median is reported.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webmill.plans.derived import Derived
from webmill.plans.registry import QUERIES
from webmill.session import build_session

HEADLINE = [
    "token_savings_by_section", "p1_canonicalise", "p4_url_key", "p11_extract_markdown", "q4_equivalence_audit",
    "p5_ai_agents", "p7_route_traffic", "p9_admit_render", "j1_auth_lookup", "j4_cache_lookup", "j5_content_bundle",
    "j6_overview", "j7_merge_starter", "j9_in_flight_followers", "j11_config_diff", "j12_golden_diff",
    "a2_section_report", "a3_usage", "a5_request_stats", "a7_fallback_alerts", "a11_token_rollup", "w3_upsert",
    "l1_rank_sections", "l2_cap_per_site", "x3_classifier_drift", "q1_unique_violations", "s3_explode_site_map",
    "p15_split_valid_metrics", "flow_serve_requests", "t4_alert_stream", "s6_content_store", "s7_metrics_sink", "t1_single_flight",
    "t2_metrics_stream", "t5_cache_state",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    started = time.time()
    tables = Derived(spark, folder)
    for name in ("domains", "tokens", "config", "published", "content", "requests", "writes"):
        getattr(tables, name)()
    prepare = time.time() - started
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            begin = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - begin)
        times[name] = round(statistics.median(runs), 3)
    html_mb = sum(r[0] for r in QUERIES["s1_load_pages"](spark, folder).selectExpr("sum(html_bytes)").collect()) / 1e6
    requests = tables.requests().count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus),
        "prepare": round(prepare, 3),
        "rates": {
            "extraction_mb_per_s": round(html_mb / times["p11_extract_markdown"], 2),
            "requests_per_s_admit": round(requests / times["p9_admit_render"]),
            "requests_per_s_cache_lookup": round(requests / times["j4_cache_lookup"]),
        }}))
    spark.stop()


if __name__ == "__main__":
    main()
