"""Time the headline queries at one scale and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "region_share", "conform_table", "parse_numbers", "dedup_last", "dimension_scd2", "fact_table", "quality_score",
    "relation_integrity", "kpi_table", "monthly_series", "concentration", "cross_facts", "market_share", "comparable_yoy",
    "moving_average", "order_deciles", "campaign_panel", "campaign_effect", "campaign_price", "edition_comparison",
    "rfm_segments", "cohorts_monthly", "segment_series", "method_comparison", "projected_series", "growth_decomposition",
    "contact_path", "classification_metrics", "collections_decision", "column_catalog", "table_freshness", "sentences",
    "meeting_minutes", "topic_mentions",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tidemark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    known = catalog.queries()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
