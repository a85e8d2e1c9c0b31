"""Tolerant coercion of wire values (all read as text) to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vidmetrics.schemas import FORMATS

_NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
# Epoch values from this one on are milliseconds (fixed value).
EPOCH_MS_FROM = 100_000_000_000


def is_empty(text: Column) -> Column:
    return text.isNull() | (text == "")


def platform_name(text: Column, default: str | None = "YOUTUBE") -> Column:
    """F1."""
    return F.upper(F.trim(F.coalesce(text, F.lit(default)) if default else text))


def source_format(platform_format: Column, media_type: Column) -> Column:
    """F3, sources: an unsupported format becomes VIDEO."""
    name = F.upper(F.coalesce(platform_format, media_type, F.lit("VIDEO")))
    return F.when(name.isin(*FORMATS), name).otherwise("VIDEO")


def snapshot_format(text: Column) -> Column:
    """F3, snapshots: an unsupported format becomes NULL."""
    name = F.upper(F.trim(text))
    return F.when(name.isin(*FORMATS), name)


def _whole(text: Column) -> Column:
    number = F.trim(text)
    return F.when(text.rlike(_INTEGER), number.try_cast("long")).when(
        text.rlike(_NUMERIC), number.try_cast("double").try_cast("long")
    )


def lenient_long(text: Column) -> Column:
    """a number, truncated; otherwise what its digits and signs begin with; '' is NULL."""
    kept = F.regexp_replace(text, r"[^0-9+\-]", "")
    leading = F.regexp_extract(kept, r"^([+-]?\d+)", 1)
    fallback = F.when(kept == "", F.lit(None).cast("long")).otherwise(
        F.coalesce(leading.try_cast("long"), F.lit(0))
    )
    return F.when(~is_empty(text), F.coalesce(_whole(text), fallback))


def lenient_double(text: Column) -> Column:
    """F5 for fractions."""
    kept = F.regexp_replace(text, r"[^0-9+\-.eE]", "")
    leading = F.regexp_extract(kept, r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?)", 1)
    fallback = F.when(kept == "", F.lit(None).cast("double")).otherwise(
        F.coalesce(leading.try_cast("double"), F.lit(0.0))
    )
    number = F.when(text.rlike(_NUMERIC), F.trim(text).try_cast("double"))
    return F.when(~is_empty(text), F.coalesce(number, fallback))


def unsigned(text: Column) -> Column:
    """truncated, negative to 0. Rows with ``not_numeric`` are to be rejected."""
    return F.when(
        ~is_empty(text) & text.rlike(_NUMERIC), F.greatest(F.lit(0).cast("long"), _whole(text))
    )


def not_numeric(text: Column) -> Column:
    return F.coalesce(~is_empty(text) & ~text.rlike(_NUMERIC), F.lit(False))


def iso_instant(text: Column) -> Column:
    """ISO text, with or without a colon in its offset; NULL when it is not one."""
    return F.coalesce(
        F.try_to_timestamp(text),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")),
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ")),
    )


def wire_instant(text: Column, arrived_at: Column) -> Column:
    """epoch seconds or milliseconds (any number, fractions and negative ones too), ISO text, or the arrival time when absent; to the ms.

    NULL means the text is there but cannot be read.
    """
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))
    fraction = F.when(text.rlike(_NUMERIC), F.trim(text).try_cast("double"))
    number = F.coalesce(
        F.when(whole >= EPOCH_MS_FROM, whole).otherwise(whole * 1000),
        F.floor(F.when(fraction >= EPOCH_MS_FROM, fraction).otherwise(fraction * 1000)),
    )
    epoch = F.timestamp_millis(number)
    return F.date_trunc(
        "millisecond",
        F.when(is_empty(text), arrived_at).when(number.isNotNull(), epoch).otherwise(iso_instant(text)),
    )


def source_instant(text: Column) -> Column:
    """whole seconds, invalid to NULL."""
    return F.date_trunc("second", F.when(~is_empty(text), iso_instant(text)))


def iso_duration_seconds(text: Column) -> Column:
    """``P1DT2H3M4S`` to seconds, invalid to NULL."""
    pattern = r"(?i)^([-+]?)P(?:([-+]?\d+)D)?(T(?:([-+]?\d+)H)?(?:([-+]?\d+)M)?(?:([-+]?\d+)(?:[.,]\d{0,9})?S)?)?$"

    def part(group: int, seconds: int) -> Column:
        return F.coalesce(F.regexp_extract(text, pattern, group).try_cast("long"), F.lit(0)) * seconds

    days = F.regexp_extract(text, pattern, 2)
    clock = F.regexp_extract(text, pattern, 3)
    sign = F.when(F.regexp_extract(text, pattern, 1) == "-", -1).otherwise(1)
    valid = text.rlike(pattern) & (F.length(clock) != 1) & ((days != "") | (clock != ""))
    return F.when(valid, (sign * (part(2, 86400) + part(4, 3600) + part(5, 60) + part(6, 1))).cast("int"))
