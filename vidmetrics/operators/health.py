"""Collector health: event folds, freshness, platform status, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmetrics.operators.spread import first_rows, instant

# --- fixed values -----------------------------------------------------------
# Parts of an error text that point to an expired or refused token.
TOKEN_SIGNS = ("401", "403", "oauth", "access token", "invalid credential", "keyinvalid", "expired")
STALE_WARNING_HOURS, STALE_CRITICAL_HOURS, TOKEN_WARNING_DAYS = 26, 72, 14
# Alert texts: platform, then the instant, count or error they name.
TEXT = {
    "token_expired_on": "Token %s expiré depuis le %s.",
    "token_expires_on": "Token %s expire le %s.",
    "token_refused_since": "Token %s expiré ou refusé depuis le %s.",
    "token_refused": "Token %s expiré ou refusé par la plateforme.",
    "error": "%s : %s",
    "error_default": "erreur de collecte",
    "no_snapshot": "%s possède %d source(s) active(s), mais aucun snapshot.",
    "never_succeeded": "%s : aucun succès de collecte rapporté.",
    "no_success_since": "%s : aucun succès de collecte depuis le %s.",
    "last_success_at": "%s : dernière collecte réussie le %s.",
    "nothing_useful_since": "%s : collecte récente, mais aucune métrique utile n’a changé depuis le %s.",
}
# ---------------------------------------------------------------------------


def token_likely_expired(message: Column) -> Column:
    """H5."""
    text = F.lower(F.coalesce(message, F.lit("null")))
    found = F.lit(False)
    for sign in TOKEN_SIGNS:
        found = found | F.contains(text, F.lit(sign))
    return found


def fold_platform_events(events: DataFrame) -> DataFrame:
    """H1: current state per platform from success and error events in ``seq`` order.

    Every field is the newest value that its rule lets through, so the fold is one aggregate with
    partial results, not an ordered walk.
    """
    rows = events.withColumn("platform", F.upper(F.trim(F.coalesce("platform", F.lit(""))))).filter(
        F.col("platform") != ""
    )
    success = F.upper("outcome") == "SUCCESS"
    expiry = F.col("token_expires_at")
    token_status = (
        F.when(success & expiry.isNotNull() & (F.unix_seconds(expiry) <= F.unix_seconds("happened_at")), "EXPIRED")
        .when(success, "OK").when(token_likely_expired(F.col("message")), "EXPIRED").otherwise("ERROR")
    )

    def newest(value: Column, among: Column) -> Column:
        boxed = F.struct(value.alias("x"))
        return F.max_by(F.when(among, boxed), F.when(among, F.col("seq"))).getField("x")

    always = F.lit(True)
    return rows.groupBy("platform").agg(
        newest(F.col("happened_at"), success).alias("last_success_at"),
        newest(F.col("snapshot_at"), success & F.col("snapshot_at").isNotNull()).alias("last_snapshot_at"),
        newest(F.when(~success, F.col("happened_at")), always).alias("last_error_at"),
        newest(F.when(~success, F.col("message")), always).alias("last_error"),
        newest(F.col("duration_ms"), always).alias("last_duration_ms"),
        newest(F.col("items"), success).alias("last_items"),
        newest(token_status, always).alias("token_status"),
        newest(expiry, success | expiry.isNotNull()).alias("token_expires_at"),
    )


def fold_batch_runs(events: DataFrame) -> DataFrame:
    """H2: first start per run, last value of everything else; unnamed runs are dropped."""
    rows = events.withColumn("run_id", F.trim(F.coalesce("run_id", F.lit("")))).filter(F.col("run_id") != "")
    last = F.struct(
        "finished_at",
        F.greatest(F.lit(0), F.col("duration_ms")).alias("duration_ms"),
        F.upper(F.trim(F.coalesce("status", F.lit("RUNNING")))).alias("status"),
        F.greatest(F.lit(0), F.col("items")).alias("items"),
        F.col("message").alias("error"),
    )
    # greatest() skips NULL, so unknown durations and counts are put back.
    known = F.struct(
        F.col("_l.finished_at"),
        F.col("_l.duration_ms"), F.col("_l.status"), F.col("_l.items"), F.col("_l.error"),
    )
    return (
        rows.withColumn("_last", last)
        .withColumn("_last", F.col("_last").withField("duration_ms", F.when(F.col("duration_ms").isNotNull(), F.col("_last.duration_ms"))))
        .withColumn("_last", F.col("_last").withField("items", F.when(F.col("items").isNotNull(), F.col("_last.items"))))
        .groupBy("run_id")
        .agg(F.min_by("started_at", "seq").alias("started_at"), F.max_by("_last", "seq").alias("_l"))
        .select("run_id", "started_at", known.alias("_l")).select("run_id", "started_at", "_l.*")
    )


def last_run(runs: DataFrame) -> DataFrame:
    """O6."""
    return runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc()).limit(1)


def platform_freshness(sv: DataFrame, ms: DataFrame) -> DataFrame:
    """Newest snapshot and number of active sources per platform."""
    newest = ms.groupBy(F.col("source_video_id").alias("id")).agg(F.max("snapshot_at").alias("at"))
    return (
        sv.filter(F.col("is_active") == 1).select("id", "platform").join(newest, "id", "left")
        .groupBy("platform").agg(F.max("at").alias("last_snapshot_at"), F.count("id").alias("source_count"))
    )


def age_hours(at: Column, as_of) -> Column:
    """H4."""
    seconds = F.unix_seconds(instant(as_of)) - F.unix_seconds(at)
    return F.when(at.isNotNull(), F.round(F.greatest(F.lit(0), seconds) / 3600.0, 1))


def _clock(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS")


def platform_status(
    sv: DataFrame, ms: DataFrame, events: DataFrame, *, as_of,
    warning_hours: int = STALE_WARNING_HOURS, critical_hours: int = STALE_CRITICAL_HOURS,
    token_days: int = TOKEN_WARNING_DAYS,
) -> DataFrame:
    """Status, token status and messages of every platform known to either side."""
    warning = max(1, warning_hours)
    critical = max(warning + 1, critical_hours)
    fresh = platform_freshness(sv, ms).withColumnRenamed("last_snapshot_at", "_measured_at")
    rows = fresh.join(fold_platform_events(events), "platform", "full_outer")
    rows = rows.withColumns({
        "source_count": F.coalesce("source_count", F.lit(0)),
        "last_snapshot_at": F.coalesce("_measured_at", "last_snapshot_at"),
        "token_status": F.upper(F.coalesce("token_status", F.lit("UNKNOWN"))),
    }).withColumns({
        "snapshot_age_hours": age_hours(F.col("last_snapshot_at"), as_of),
        "success_age_hours": age_hours(F.col("last_success_at"), as_of),
    })
    name = F.col("platform")

    def say(key: str, *args: Column) -> Column:
        return F.format_string(TEXT[key], name, *args)

    expiry = F.col("token_expires_at")
    left = F.unix_seconds(expiry) - F.unix_seconds(instant(as_of))
    gone, soon = left <= 0, (left > 0) & (left <= token_days * 86400)
    rows = rows.withColumns({
        "status": F.when(gone, "ERROR").when(soon, "WARNING").otherwise("OK"),
        "token_status": F.when(gone, "EXPIRED").when(soon, "WARNING").otherwise(F.col("token_status")),
        "m1": F.when(gone, say("token_expired_on", _clock(expiry))).when(soon, say("token_expires_on", _clock(expiry))),
    })

    def at_least_warning(condition: Column) -> Column:
        return F.when(condition & (F.col("status") == "OK"), "WARNING").otherwise(F.col("status"))

    token, error = F.col("token_status"), F.col("last_error")
    refused, failed = token == "EXPIRED", token == "ERROR"
    has_error = F.coalesce(error, F.lit("")) != ""
    rows = rows.withColumns({
        "status": F.when(refused | failed, "ERROR").otherwise(at_least_warning(has_error)),
        "m2": F.when(
            refused,
            F.when(F.col("last_error_at").isNotNull(), say("token_refused_since", _clock(F.col("last_error_at"))))
            .otherwise(say("token_refused")),
        ).when(failed, say("error", F.coalesce(error, F.lit(TEXT["error_default"]))))
        .when(has_error, say("error", error)),
    })
    sources, no_snapshot = F.col("source_count") > 0, F.col("last_snapshot_at").isNull()
    rows = rows.withColumns({
        "status": F.when(sources & no_snapshot, "ERROR").otherwise(F.col("status")),
        "m3": F.when(sources & no_snapshot, say("no_snapshot", F.col("source_count"))),
    })
    success, success_age = F.col("last_success_at"), F.col("success_age_hours")
    never = success.isNull()
    too_old = ~never & (success_age >= critical)
    late = ~never & ~too_old & (success_age >= warning) & (F.col("status") == "OK")
    rows = rows.withColumns({
        "status": F.when(never & sources, at_least_warning(F.lit(True))).when(too_old, "ERROR")
        .when(late, "WARNING").otherwise(F.col("status")),
        "m4": F.when(never & sources, say("never_succeeded")).when(too_old, say("no_success_since", _clock(success)))
        .when(late, say("last_success_at", _clock(success))),
    })
    idle = (
        (F.col("snapshot_age_hours") >= critical) & (success_age < warning) & (F.col("status") == "OK")
    )
    rows = rows.withColumns({
        "status": F.when(idle, "WARNING").otherwise(F.col("status")),
        "m5": F.when(idle, say("nothing_useful_since", _clock(F.col("last_snapshot_at")))),
    })
    messages = F.array_distinct(F.array_compact(F.array("m1", "m2", "m3", "m4", "m5")))
    return rows.withColumn("messages", messages).select(
        "platform", "status", "token_status", "token_expires_at", "last_success_at", "success_age_hours",
        "last_snapshot_at", "snapshot_age_hours", "last_duration_ms", "last_items", "last_error_at",
        "last_error", "source_count", F.try_element_at("messages", F.lit(1)).alias("message"), "messages",
    )


def alerts(status: DataFrame) -> DataFrame:
    """The distinct messages of all platforms."""
    return status.select(F.explode("messages").alias("message")).distinct()


def collection_quality(ms: DataFrame, sv: DataFrame, events: DataFrame, gaps: DataFrame) -> DataFrame:
    """Mean delay between measure and storage, missing windows and error rate per platform."""
    sources = sv.select(F.col("id").alias("source_video_id"), "platform")
    delay = F.unix_millis("created_at") - F.unix_millis("snapshot_at")
    delays = (
        ms.groupBy("source_video_id").agg(F.sum(delay).alias("d"), F.count("*").alias("n"))
        .join(sources, "source_video_id").groupBy("platform")
        .agg((F.sum("d") / F.sum("n") / 1000.0).alias("mean_latency_seconds"))
    )
    missing = (
        gaps.groupBy("source_video_id").agg(F.count("*").alias("n"))
        .join(sources, "source_video_id").groupBy("platform").agg(F.sum("n").alias("missing_windows"))
    )
    failed = F.count_if(F.upper("outcome") != "SUCCESS")
    errors = events.groupBy("platform").agg((failed / F.count("*")).alias("error_rate"))
    return (
        delays.join(missing, "platform", "full_outer").join(errors, "platform", "full_outer")
        .withColumn("missing_windows", F.coalesce("missing_windows", F.lit(0)))
    )


def newest_success_per_platform(events: DataFrame) -> DataFrame:
    """The whole event behind ``last_success_at``."""
    good = events.filter(F.upper("outcome") == "SUCCESS")
    return first_rows(good, ["platform"], [F.col("seq").desc()])
