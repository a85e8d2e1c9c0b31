"""Watch time as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_LENGTH = 300


def average_length(own: Column, mean_of_sources: Column) -> Column:
    """Own length, else the mean known length of the sources, else five minutes."""
    return F.coalesce(
        F.when(own > 0, F.floor(own + 0.5)), F.floor(mean_of_sources + 0.5), F.lit(DEFAULT_LENGTH)
    )


def hms_seconds(text: Column) -> Column:
    """``h:m:s`` or ``m:s`` to seconds; anything else is 0."""
    parts = F.transform(F.split(text, ":"), lambda p: F.trim(p).try_cast("double"))
    whole = F.forall(parts, lambda p: p.isNotNull())
    three = F.try_element_at(parts, F.lit(1)) * 3600 + F.try_element_at(parts, F.lit(2)) * 60 + F.try_element_at(parts, F.lit(3))
    two = F.try_element_at(parts, F.lit(1)) * 60 + F.try_element_at(parts, F.lit(2))
    return (
        F.when(~F.coalesce(whole, F.lit(False)), F.lit(0.0))
        .when(F.size(parts) == 3, three).when(F.size(parts) == 2, two).otherwise(F.lit(0.0))
    )


def reported_watch_seconds(columns: Sequence[str]) -> list[Column]:
    """The explicit watch times a latest point may carry, all in seconds."""
    def number(name: str) -> Column:
        return F.col(name).cast("double")

    def first_nonzero(*names: str) -> Column | None:
        present = [F.when(number(n) != 0, number(n)) for n in names if n in columns]
        return F.coalesce(*present) if present else None

    found = [
        number(n) for n in ("total_watch_seconds", "watch_time_seconds", "watch_seconds") if n in columns
    ]
    millis = first_nonzero("watch_time_ms", "watch_ms", "watch_eq_ms")
    if millis is not None:
        found.append(F.floor(millis / 1000 + 0.5).cast("double"))
    minutes = first_nonzero("estimated_minutes_watched", "watch_minutes")
    if minutes is not None:
        found.append(minutes * 60)
    if "watch_time_hms" in columns:
        found.append(hms_seconds(F.col("watch_time_hms")))
    return found


def plausible_watch_seconds(
    reported: list[Column], views: Column, length: Column, average: Column, share: Column
) -> Column:
    """the smallest positive reported time, else the smallest derived one, at most views x length."""
    cap = F.when((views > 0) & (length > 0), views * length)

    def smallest_positive(values: list[Column]) -> Column:
        return F.array_min(F.filter(F.array(*values), lambda x: x > 0))

    def nonzero(value: Column) -> Column:
        return F.when((value != 0) & (views != 0), value)

    derived = F.array_min(F.array(
        nonzero(average.cast("double") * views), nonzero(share.cast("double") * length * views)
    ))
    chosen = F.coalesce(smallest_positive(reported), derived) if reported else derived
    # least() skips NULL, so a missing choice is settled first.
    return F.when(chosen.isNull(), F.lit(0.0)).otherwise(F.least(chosen, cap))
