"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

from vidmetrics.fixtures import Fixtures  # noqa: E402
from vidmetrics.plans.registry import QUERIES  # noqa: E402
from vidmetrics.session import build_session  # noqa: E402

HEADLINE = (
    "enriched_snapshots", "latest_enriched", "video_rollup", "list_views_desc", "list_with_trend", "video_trend",
    "detail_watch_seconds", "series_hour_platform", "series_cumsum", "aligned_raw", "aligned_dense",
    "percentile_bands", "bands_carried", "duplicate_pairs", "sparse_decisions", "ingest_report", "upsert_sources",
    "reconcile_clusters", "reconcile_links", "platform_status", "overview_kpis", "delta_24h", "gaps_3h", "anomalies",
    "insights_flat",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "vidmetrics-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           # Partitions of a few hundred kilobytes are normal at this scale; use every core for them.
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    fixtures = Fixtures(spark, sf_dir)
    names = sys.argv[1:] or HEADLINE
    fixtures.source_video.write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](fixtures).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
