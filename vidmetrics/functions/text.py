"""Titles and descriptions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Words a title loses before two titles are compared.
TITLE_NOISE = ("teaser", "bande-annonce", "preview", "extrait")
# Words that mark a teaser, and the length up to which any video counts as one.
TEASER_WORDS = ("teaser", "extrait", "trailer", "bande-annonce", "short", "extract", "sneak peek")
TEASER_SECONDS = 45
UNTITLED = "(sans titre)"
# ---------------------------------------------------------------------------


def is_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"^[\s\x00]*$")


def normal_title(title: Column) -> Column:
    """lower case, noise words dropped at word borders, separators collapsed."""
    words = "|".join(TITLE_NOISE)
    text = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), rf"(?U)\b({words})\b", "")
    return F.trim(F.regexp_replace(text, r"(?U)[\s\-_:;,.!?()\[\]{}]+", " "))


def fuzzy_text(text: Column) -> Column:
    """lower case, combining marks dropped, everything but ``a-z0-9`` to single spaces."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[̀-ͯ]", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def is_teaser(title: Column, description: Column, seconds: Column) -> Column:
    """F11."""
    found = F.coalesce(seconds <= TEASER_SECONDS, F.lit(False))
    for text in (title, description):
        lowered = F.lower(F.coalesce(text, F.lit("")))
        for word in TEASER_WORDS:
            found = found | F.contains(lowered, F.lit(word))
    return found


def abbreviated(text: Column, width: int = 160) -> Column:
    """cut to ``width`` characters, the last three being dots."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    ).otherwise(text)


def truncated(text: Column, width: int = 140) -> Column:
    return F.substring(text, 1, width)


def zurich_time(utc: Column) -> Column:
    """the wall clock in Zurich of a UTC instant."""
    return F.from_utc_timestamp(utc, "Europe/Zurich")
