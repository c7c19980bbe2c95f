"""Headline queries at one scale; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

HEADLINE = (
    "o1_list_page", "p9_search_text", "w7_clamped_page", "o5_board", "j1_lend_by_key", "j4_snapshot_diff", "j5a_change_kind",
    "j7_settled_groups", "j8_action_reaches_copies", "u2_merge_policy", "u9_action_fold", "u6_ignore_silent", "a7_copy_groups",
    "a16_percentile", "w6_drop_outs", "s1_changelog_batch", "s3_digest_tail", "st1_changelog_stream", "f2_strip_html",
    "f8_detect_language", "f11_pay_text", "f23_clause_count", "w9_section_state", "a9_score_totals", "b_first_reason", "r_score_documents",
)


def consume(df: DataFrame) -> None:
    """Compute every output column without moving rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from listtide.plans import catalog

    # Start the JVM's and the Python workers' machinery before the clock runs.
    consume(catalog.QUERIES["f3_entities"](spark, sf))
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        consume(catalog.QUERIES[name](spark, sf))
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
