"""Headline queries, timed one after another; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` choose data and cores.
Stored stages (silver, gold, statistics, dataset) are timed where they are
built; later queries read them, as a scheduled run would.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.operators import model  # noqa: E402
from panelwright.plans import catalog, loading, pipeline  # noqa: E402
from panelwright.session import build_session, shared_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "record_hash",
    "resume_missing",
    "bronze_audit",
    "version_changeset",
    "text_roundtrip",
    "check_masks",
    "scope_funnel",
    "silver_build",
    "quarantine_by_reason",
    "month_end_series",
    "silver_panel",
    "gold_panel",
    "consecutive_change",
    "lag_correlation",
    "product_table",
    "key_table",
    "ml_features",
    "ml_dataset",
    "auc_weighted",
    "threshold_sensitivity",
    "recommendation",
    "closing_numbers",
    "key_status",
    "serve_key_series",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def archive_loads(spark) -> dict[str, float]:
    """The bronze rows written as archives, loaded, and loaded again when nothing is new."""
    folder = f"{shared_dir(spark)}/bench-{uuid.uuid4().hex}"
    required = ["date_text", "entity", "product", "quantity_text", "value_text"]
    steps = {"archives_written": lambda: pipeline.st.write_files(pipeline.bronze(spark, SF_DIR), f"{folder}/in", "zip")}
    for name in ("archive_load_first", "archive_load_again"):
        steps[name] = lambda: loading.load_archives(
            spark, f"{folder}/in", f"{folder}/_bronze", f"{folder}/_control", required, "panel-source", "bench", pipeline.st.RUN_AT
        )
    times = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    spark = build_session("panelwright-bench", CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "watermark")  # start-up of the session, not counted
    start = time.perf_counter()
    pipeline.bronze(spark, SF_DIR)
    times = {"bronze_stage": round(time.perf_counter() - start, 3)}
    times |= archive_loads(spark)
    for name in HEADLINE:
        if name == "gold_panel":  # gold alone, from stored silver tables
            start = time.perf_counter()
            pipeline.panel_table(spark, SF_DIR), pipeline.series(spark, SF_DIR)
            times["silver_tables"] = round(time.perf_counter() - start, 3)
        times[name] = run(spark, name)
    start = time.perf_counter()
    catalog.final_run(spark, SF_DIR, model.LOGISTIC).metrics.write.format("noop").mode("overwrite").save()
    times["ml_final_test_logistic"] = round(time.perf_counter() - start, 3)
    times["ml_importance"] = run(spark, "permutation_importance")
    if os.environ.get("BENCH_ML", "1") == "1":
        times["ml_rolling_selection"] = run(spark, "rolling_eval")
    rows = pipeline.st.table(spark, SF_DIR, "lineitem").count()
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
                "source_rows": rows,
                "silver_rows_per_sec": round(rows / times["silver_build"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
