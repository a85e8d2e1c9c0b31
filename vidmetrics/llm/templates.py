"""Benchmark decontamination by templates, in built-in functions only.

A text becomes a template: names, numbers and units turn into typed placeholders, case and punctuation
go. Windows of template words of the benchmark are hash-joined with those of the documents. Where
windows meet, the text's values are laid beside the benchmark's: a re-parameterised question may change
values, but one value must change into one value throughout, or the windows are no evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import of_keys, saved

# --- fixed values: units and white space ---------------------------------------
UNITS = (
    "mm cm dm m km in ft yd mi mg g kg t lb oz ml cl l ms s sec min h hr hrs day days week weeks year years "
    "mph kmh kb mb gb tb hz khz mhz ghz w kw mw kwh v mv j kj cal kcal pa kpa usd eur gbp chf dollars euros cents percent"
).split()
SPACE = r" \t\n\x0B\f\r"
# -------------------------------------------------------------------------------
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
WINDOW, LEAST_LITERALS, COVERAGE, SHORTEST = 6, 3, 0.4, 3
#: Benchmark windows that may be sent to all executors: 24 bytes each.
BROADCAST_WINDOWS = 500_000

_NUMBERS = r"[0-9]+([.,:/-][0-9]+)*"
_UNITS = rf"(?i)(\x02[{SPACE}]?)({'|'.join(UNITS)})([^\p{{L}}\p{{N}}\x01-\x03]|$)"
_FIRST_NAMES = rf"([\p{{Ll}},;:\x02\x03][{SPACE}])\p{{Lu}}\p{{L}}*"
_NEXT_NAMES = rf"(\x01[{SPACE}])\p{{Lu}}\p{{L}}*"
_OTHER = rf"[^\p{{L}}\x01-\x03{SPACE}]+"


def template_text(text: Column, *, names: bool = True) -> Column:
    """``text`` with placeholders; white space stays, so words keep their places.

    A number is digits with inner separators; a unit follows a number, with a space or without; a name is
    a capitalised word after a word, number, unit, comma, semicolon or colon, and up to two more after it. Without ``names`` the template is
    free of case: names stay as words, in lower case like the others, and have the same places.
    """
    out = F.regexp_replace(F.translate(text, NAME + NUMBER + UNIT, ""), _NUMBERS, NUMBER)
    out = F.regexp_replace(out, _UNITS, rf"$1{UNIT}$3")
    if not names:
        # Through upper case, for letters like the sharp s; Spark reads lower(upper(x)) as lower(x).
        return F.lower(F.regexp_replace(F.upper(F.regexp_replace(out, _OTHER, "")), _OTHER, ""))
    out = F.regexp_replace(out, _FIRST_NAMES, rf"$1{NAME}")
    for _ in range(2):
        out = F.regexp_replace(out, _NEXT_NAMES, rf"$1{NAME}")
    return F.regexp_replace(F.lower(out), _OTHER, "")


def _cells(text: Column) -> Column:
    return F.split(text, f"[{SPACE}]")


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def window_hashes(words: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, by their first word; fewer words: none."""
    one = F.transform(words, lambda w: F.xxhash64(w))
    powers = {1: one}
    done, out = 0, None
    k = 1
    while k <= size:
        if k > 1:
            half = powers[k // 2]
            powers[k] = F.zip_with(half, _shift(half, k // 2), lambda a, b: F.xxhash64(a, b))
        k *= 2
    for k in sorted(powers, reverse=True):
        if size - done >= k:
            part = _shift(powers[k], done) if done else powers[k]
            out = part if out is None else F.zip_with(out, part, lambda a, b: F.xxhash64(a, b))
            done += k
    return F.slice(out, 1, F.greatest(F.size(words) - (size - 1), F.lit(0)))


#: Kinds of templates: with names, and free of case.
WITH_NAMES, ANY_CASE = 0, 1


def _of_kinds(kinds: list[int], make) -> DataFrame:
    """The rows that ``make`` gives for templates with names or without, with their kind."""
    out = None
    for kind in kinds:
        rows = make(kind == WITH_NAMES).withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


def _template_rows(rows: DataFrame, key: str, names: bool = True) -> DataFrame:
    """(key, words): the template words of each text with a text and a key."""
    kept = rows.select(F.col(key).cast("long").alias(key), F.col("text").cast("string").alias("text"))
    words = F.filter(_cells(template_text(F.col("text"), names=names)), lambda w: w != "")
    return kept.filter(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, words.alias("words"))


def _windows(words: DataFrame, key: str, sizes: list[int], name: str) -> DataFrame:
    """(key, name: place of the first word, size, hash) of all windows."""
    each = [_numbered(F.col("words"), n, name) for n in sizes]
    return words.select(key, F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("w")).select(key, f"w.{name}", "w.size", "w.hash")


def _numbered(words: Column, size: int, name: str) -> Column:
    return F.transform(
        window_hashes(words, size), lambda h, i: F.struct(i.cast("long").alias(name), F.lit(size).alias("size"), h.alias("hash"))
    )


def _slots(rows: DataFrame, key: str, place: str, value: str, names: bool = True) -> DataFrame:
    """(key, place, value) of the words that a placeholder stands for."""
    text = F.col("text").cast("string")
    pairs = F.filter(
        F.arrays_zip(_cells(template_text(text, names=names)).alias("t"), _cells(F.translate(text, NAME + NUMBER + UNIT, "")).alias("raw")),
        lambda p: p["t"] != "",
    )
    kept = rows.filter(F.col(key).isNotNull() & text.isNotNull()).select(F.col(key).cast("long").alias(key), F.posexplode(pairs).alias(place, "p"))
    marked = F.col("p.t").rlike("[\x01-\x03]")
    return kept.filter(marked).select(
        key, F.col(place).cast("long").alias(place), F.expr("lower(rtrim('.,;:!?', p.raw))").alias(value)
    )


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, least_literals: int = LEAST_LITERALS, coverage: float = COVERAGE,
    any_case: bool = False, by_window: bool = False,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, n_windows (distinct windows of the
    item that are evidence), item_words, covered_words, n_slots, n_changed.

    Evidence are windows of ``window`` template words, at least ``least_literals`` of them no placeholder, that
    occur in both texts, on a line (place in the document less place in the item) whose slots are
    consistent: equal values of the item stand against equal values of the document. The item is found
    if evidence covers ``coverage`` of its words. Items of fewer words than a window count as one window;
    items of fewer than three words, and rows with a null id or text, take no part. Rows that share a
    doc_id or an item_id count as one.

    ``any_case``: windows may also meet in templates free of case, so a passage in capitals, or behind
    another word, is found; either kind is evidence. ``by_window``: an inconsistent slot takes away the
    windows that hold it, and not its whole line; n_slots and n_changed count the places of what remains.
    """
    kinds = [WITH_NAMES, ANY_CASE] if any_case else [WITH_NAMES]
    items = saved(
        _of_kinds(kinds, lambda names: _template_rows(benchmark, "item_id", names)).withColumn("words_n", F.size("words").cast("long")), "items"
    )
    short = sorted(r[0] for r in items.select("words_n").distinct().filter(f"words_n >= {SHORTEST} and words_n < {window}").collect())
    sizes = [window, *short]  # fewer than ``window`` numbers
    literal = F.size(F.filter(F.slice("words", F.col("item_at") + 1, F.col("size")), lambda w: ~w.rlike("[\x01-\x03]")))
    of_items = _of_kinds(kinds, lambda names: _item_windows(items.filter(F.col("kind") == (WITH_NAMES if names else ANY_CASE)), sizes, literal, window, least_literals))
    of_items = saved(of_items.distinct(), "item-windows")
    few = of_items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    found = _of_kinds(kinds, lambda names: _windows(_template_rows(docs, "doc_id", names), "doc_id", sizes, "doc_at")).join(
        F.broadcast(of_items) if few else of_items, ["kind", "size", "hash"]
    )
    line = ["doc_id", "item_id", "kind", "line"]
    found = saved(
        found.select("doc_id", "item_id", "kind", "item_at", "size", (F.col("doc_at") - F.col("item_at")).alias("line")).distinct(), "meetings"
    )

    # Places of the item under evidence, by line, and the values that meet there.
    places = _places(found, line)
    item_slots = saved(_of_kinds(kinds, lambda names: _slots(benchmark, "item_id", "place", "item_value", names)).distinct(), "item-slots")
    # Only texts that met an item with slots have values to compare.
    slotted = found.join(item_slots.select("item_id", "kind").distinct(), ["item_id", "kind"], "left_semi")
    suspects = of_keys(docs.select("doc_id", "text"), slotted.select("doc_id").distinct(), "doc_id", "left_semi")
    of_docs = _of_kinds(kinds, lambda names: _slots(suspects, "doc_id", "doc_place", "doc_value", names)).distinct()
    met = (
        places.join(item_slots, ["item_id", "kind", "place"]).withColumn("doc_place", F.col("place") + F.col("line"))
        .join(of_docs, ["doc_id", "kind", "doc_place"])
    )
    if by_window:
        met = saved(met, "met-values")
        values = [*line, "item_value"]
        torn = met.groupBy(*values).agg(F.countDistinct("doc_value").alias("n")).filter("n > 1").select(*values)
        torn = met.join(torn, values, "left_semi").select(*line, "place").distinct()
        windows = [*line, "item_at", "size"]
        holding = found.join(torn, line).filter("place >= item_at and place < item_at + size").select(*windows).distinct()
        found = saved(found.join(holding, windows, "left_anti"), "whole-meetings")
        places = _places(found, line)
        met = met.join(places, [*line, "place"], "left_semi")
    by_line = met.groupBy(*line).agg(
        F.countDistinct("item_value").alias("values"), F.countDistinct("item_value", "doc_value").alias("pairs"),
        F.countDistinct("place").alias("slots"),
        F.countDistinct(F.when(F.col("item_value") != F.col("doc_value"), F.col("place"))).alias("changed"),
    )
    odd = by_line.filter("pairs > values").select(*line)
    changes = by_line.filter("pairs <= values").groupBy("doc_id", "item_id").agg(
        F.sum("slots").alias("n_slots"), F.sum("changed").alias("n_changed")
    )
    sizes_of = items.groupBy("item_id").agg(F.max("words_n").alias("item_words"))
    evidence = found.join(odd, line, "left_anti").groupBy("doc_id", "item_id").agg(F.countDistinct("item_at", "size").alias("n_windows"))
    covered = places.join(odd, line, "left_anti").groupBy("doc_id", "item_id").agg(F.countDistinct("place").alias("covered_words"))
    out = evidence.join(covered, ["doc_id", "item_id"]).join(sizes_of, "item_id").filter(F.col("covered_words") >= coverage * F.col("item_words"))
    return out.join(changes, ["doc_id", "item_id"], "left").select(
        "doc_id", "item_id", "n_windows", "item_words", "covered_words",
        F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), F.coalesce("n_changed", F.lit(0)).cast("long").alias("n_changed"),
    )


def _item_windows(items: DataFrame, sizes: list[int], literal: Column, window: int, least_literals: int) -> DataFrame:
    """(item_id, item_at, size, hash) of the windows of items that may be evidence."""
    made = _windows(items, "item_id", sizes, "item_at").join(items.withColumnRenamed("item_id", "_item"), F.col("item_id") == F.col("_item"))
    return made.filter(
        ((F.col("size") == window) | (F.col("size") == F.col("words_n"))) & (literal >= F.least(F.lit(least_literals), F.col("size")))
    ).select("item_id", "item_at", "size", "hash")


def _places(found: DataFrame, line: list[str]) -> DataFrame:
    return found.select(*line, F.explode(F.sequence("item_at", F.col("item_at") + F.col("size") - 1)).alias("place")).distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which an item is found; columns and all other rows as they are."""
    ids = leaks(docs.select("doc_id", "text"), benchmark, **options).select("doc_id").distinct()
    return of_keys(docs, saved(ids, "leaked"), "doc_id", "left_anti")
