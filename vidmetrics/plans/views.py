"""End-user queries composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from vidmetrics.operators import catalog, health, ingest, reconcile, series, trend
from vidmetrics.operators.enrich import latest_enriched, series_top_n
from vidmetrics.operators.rollup import engagement_table, overview_kpis, video_rollup
from vidmetrics.session import ensure_checkpoint_dir
from vidmetrics.sources import tables


@dataclass(frozen=True)
class VideoDetail:
    """Q2."""

    video: DataFrame
    rollup: DataFrame
    sources: DataFrame
    latest: DataFrame
    points: DataFrame
    totals: DataFrame
    watch: DataFrame


def video_detail(ms: DataFrame, sv: DataFrame, v: DataFrame, *, points: int = 50, **key) -> VideoDetail:
    """Q2: one video with its rollup, sources, latest points, series and totals."""
    video = catalog.find_video(v, sv, **key)
    sources = sv.join(video.select(F.col("id").alias("video_id")), "video_id", "left_semi")
    snapshots = ms.join(sources.select(F.col("id").alias("source_video_id")), "source_video_id", "left_semi")
    return VideoDetail(
        video=video,
        rollup=video_rollup(snapshots, sources, video, as_table=True),
        sources=catalog.ordered_sources(sources),
        latest=latest_enriched(snapshots, sources, video),
        points=series_top_n(snapshots, sources, video, points),
        totals=catalog.detail_totals(snapshots, sources, video),
        watch=catalog.detail_watch_seconds(snapshots, sources, video),
    )


@dataclass(frozen=True)
class VideoSeries:
    """Q3."""

    by_platform: DataFrame
    overall: DataFrame
    warnings: DataFrame
    bands: DataFrame | None


def video_series(
    ms: DataFrame, sv: DataFrame, v: DataFrame, *, as_of, metric: str = "views_native",
    interval: str = "hour", range_text: str = "all", platforms=None, running: bool = False,
    limit: int = 0, bands: DataFrame | None = None,
) -> VideoSeries:
    """Q3: series of one metric, global and per platform; running totals come before downsampling."""
    raw = series.bucket_series(
        ms, sv, v, as_of=as_of, metric=metric, interval=interval, range_text=range_text, platforms=platforms
    )
    shown, overall = raw, series.global_series(raw)
    if running:
        shown, overall = series.cumsum(shown), series.cumsum(overall, ["video_id"])
    if limit > 0:
        shown, overall = series.downsample(shown, limit), series.downsample(overall, limit, ["video_id"])
    clipped = None
    if bands is not None and metric == "views_native":
        clipped = series.clip_bands(bands, shown, v, granularity=interval)
    return VideoSeries(shown, overall, series.non_monotonic(raw), clipped)


@dataclass(frozen=True)
class HealthDocument:
    """Q5, H6."""

    platforms: DataFrame
    alerts: DataFrame
    last_batch: DataFrame


def health_document(sv: DataFrame, ms: DataFrame, platform_events: DataFrame, batch_events: DataFrame, *, as_of) -> HealthDocument:
    status = health.platform_status(sv, ms, platform_events, as_of=as_of)
    return HealthDocument(
        status.orderBy("platform"), health.alerts(status), health.last_run(health.fold_batch_runs(batch_events))
    )


@dataclass(frozen=True)
class Overview:
    """Q8."""

    platforms: DataFrame
    alerts: DataFrame
    latest_video: DataFrame
    engagement: DataFrame


def overview(ms: DataFrame, sv: DataFrame, v: DataFrame, *, as_of, limit: int = 20, platform: str | None = None) -> Overview:
    """Q8: totals per platform, the sources that gain most (of one platform, if given), the newest video and
    the engagement of every (video, platform)."""
    newest = v.orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(1)
    alerts = trend.top_accelerating(ms, sv, as_of=as_of, limit=limit, platform=platform)
    return Overview(overview_kpis(ms, sv), alerts, newest, engagement_table(ms, sv, v))


@dataclass(frozen=True)
class Ingestion:
    """I10."""

    sources: DataFrame
    decisions: DataFrame
    stored: DataFrame
    rejected: DataFrame
    report: DataFrame


def ingest_items(items: DataFrame, sv: DataFrame, ms: DataFrame, **options) -> Ingestion:
    """Resolve or create sources, decide, report. ``items`` come from ``metric_items`` with an
    ``arrival_seq``; items with a problem are counted, not fatal."""
    good = items.filter(F.col("problem").isNull()).drop("problem")
    rejected = items.filter(F.col("problem").isNotNull() & ~F.col("problem").startswith("skipped"))
    filled = tables.fill_formats(sv, good)
    sources = filled.unionByName(tables.create_minimal_sources(sv, good), allowMissingColumns=True)
    decisions = ingest.sparse_fold(tables.resolve_items(good, sources), ms, **options)
    return Ingestion(
        sources, decisions, ingest.stored_points(decisions), rejected,
        ingest.ingest_totals(ingest.ingest_report(decisions, rejected)),
    )


def ingest_to(items: DataFrame, sv: DataFrame, ms: DataFrame, path: str, **options) -> dict[str, int]:
    """I10 as a job: one evaluation of the items feeds both sinks and the report.

    Decided items go to ``sink=decided`` and rejected ones to ``sink=rejected`` below ``path`` in one write, and the
    counts of the report are observed while it runs, so nothing is read again to be counted. Returns ok, ko, stored,
    skipped and monotonic_corrections.
    """
    ensure_checkpoint_dir(items.sparkSession)
    run = ingest_items(items.checkpoint(), sv, ms, **options)
    counters = [c for c in run.decisions.columns if c not in ("stored", "reason", "monotonic_corrections", "views_delta")]
    decided = run.decisions.withColumn("sink", F.lit("decided"))
    rejected = run.rejected.select(
        *[F.col(c) for c in counters if c in run.rejected.columns], F.col("problem").alias("reason"), F.lit(False).alias("stored"), F.lit("rejected").alias("sink"),
    )
    good = F.col("sink") == "decided"
    counts = Observation()
    rows = decided.unionByName(rejected, allowMissingColumns=True).observe(
        counts, F.count_if(good).alias("ok"), F.count_if(~good).alias("ko"), F.count_if(good & F.col("stored")).alias("stored"),
        F.count_if(good & ~F.col("stored")).alias("skipped"), F.coalesce(F.sum("monotonic_corrections"), F.lit(0)).alias("monotonic_corrections"),
    )
    rows.write.mode("overwrite").partitionBy("sink").parquet(path)
    return counts.get


def health_rows(document: HealthDocument) -> DataFrame:
    """Q5, H6 as one tagged set of rows (part, name, status, at, message): platforms, alerts, the last batch run."""
    platforms = document.platforms.select(
        F.lit("platform").alias("part"), F.col("platform").alias("name"), "status", F.col("last_success_at").alias("at"), F.col("last_error").alias("message")
    )
    no = F.lit(None).cast("string")
    alerts = document.alerts.select(F.lit("alert").alias("part"), no.alias("name"), no.alias("status"), F.lit(None).cast("timestamp").alias("at"), "message")
    batch = document.last_batch.select(F.lit("batch").alias("part"), F.col("run_id").alias("name"), "status", F.col("finished_at").alias("at"), F.col("error").alias("message"))
    return platforms.unionByName(alerts).unionByName(batch)


def reconcile_with_overrides(
    sv: DataFrame, v: DataFrame, overrides: DataFrame, *, hours: int = 48
) -> tuple[reconcile.Reconciliation, DataFrame]:
    """Q7: pending overrides first, then the clusters; returns the run and its report."""
    applied = reconcile.override_report(overrides).first()["applied"]
    run = reconcile.reconcile(reconcile.apply_overrides(sv, overrides), v, hours=hours)
    return run, run.report(int(applied))
