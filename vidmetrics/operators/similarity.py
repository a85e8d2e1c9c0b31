"""Fuzzy scores of candidate pairs and the groups they form."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vidmetrics.functions.text import fuzzy_text
from vidmetrics.session import ensure_checkpoint_dir

# --- fixed values: weights of the score and the link threshold --------------
TITLE_WEIGHT, DESCRIPTION_WEIGHT, TIME_WEIGHT = 0.6, 0.3, 0.1
TIME_BONUS_HOURS = 72
LINK_THRESHOLD = 0.78
# Jaro-Winkler: boost from this similarity on, per common first character, up to four.
BOOST_FROM, BOOST_STEP, BOOST_CHARS = 0.7, 0.1, 4
# ---------------------------------------------------------------------------


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two texts by the published Jaro-Winkler definition."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    reach = max(len(b) // 2 - 1, 0)
    taken = [False] * len(b)
    common_a = []
    for i, char in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == char:
                taken[j] = True
                common_a.append(char)
                break
    m = len(common_a)
    if m == 0:
        return 0.0
    common_b = [char for char, used in zip(b, taken) if used]
    moved = sum(x != y for x, y in zip(common_a, common_b)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    if jaro < BOOST_FROM:
        return jaro
    prefix = 0
    for x, y in zip(a[:BOOST_CHARS], b[:BOOST_CHARS]):
        if x != y:
            break
        prefix += 1
    return jaro + BOOST_STEP * prefix * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_column(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def _text_scores(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds ``name``: equal texts are 1 without leaving the JVM; other texts are scored once per
    distinct pair."""
    low, high = F.least(a, b), F.greatest(a, b)
    keyed = pairs.withColumns({"_low": low, "_high": high})
    scored = (
        keyed.filter(F.col("_low") != F.col("_high")).select("_low", "_high").distinct()
        .withColumn("_s", jaro_winkler_column("_low", "_high"))
    )
    return keyed.join(scored, ["_low", "_high"], "left").withColumn(
        name, F.when(F.col("_low") == F.col("_high"), F.lit(1.0)).otherwise(F.col("_s"))
    ).drop("_low", "_high", "_s")


def score_pairs(pairs: DataFrame, sv: DataFrame) -> DataFrame:
    """(a_id, b_id, title_score, description_score, score) of candidate pairs of sources."""
    texts = sv.select(
        "id", fuzzy_text(F.col("title")).alias("t"), fuzzy_text(F.col("description")).alias("d"), "published_at"
    )
    rows = pairs.select("a_id", "b_id")
    for side in ("a", "b"):
        rows = rows.join(texts.select(*[F.col(c).alias(f"{side}_{c}") for c in texts.columns]), f"{side}_id")
    rows = _text_scores(rows, "a_t", "b_t", "title_score")
    rows = _text_scores(rows, "a_d", "b_d", "_both")
    described = (F.col("a_d") != "") & (F.col("b_d") != "")
    hours = F.floor(F.abs(F.unix_millis("a_published_at") - F.unix_millis("b_published_at")) / 3_600_000)
    bonus = F.when(hours <= TIME_BONUS_HOURS, TIME_WEIGHT * (1 - hours / TIME_BONUS_HOURS)).otherwise(0.0)
    rows = rows.withColumn("description_score", F.when(described, F.col("_both")).otherwise(0.0))
    total = (
        TITLE_WEIGHT * F.col("title_score") + DESCRIPTION_WEIGHT * F.col("description_score")
        + F.coalesce(bonus, F.lit(0.0))
    )
    return rows.select(
        "a_id", "b_id", "title_score", "description_score",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"),
    )


def similar_pairs(pairs: DataFrame, sv: DataFrame, *, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """J16 on given candidates: the pairs that reach the link threshold."""
    return score_pairs(pairs, sv).filter(F.col("score") >= threshold)


#: Letters of a fuzzy text, occurrences of a letter that a signature tells apart, letters in one long of it.
_LETTERS, _DEEP, _PER_LONG = " abcdefghijklmnopqrstuvwxyz0123456789", 6, 10
_LONGS = -(-len(_LETTERS) // _PER_LONG)
#: Lengths of texts are cells of this ratio.
_RATIO, _CELLS = 1.3, 40


def _times(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _signature(text: Column) -> Column:
    """Length, first letters and letter counts: one bit per letter and occurrence, up to ``_DEEP``, and the rest as a sum."""
    longs = []
    for k in range(_LONGS):
        part = F.lit(0).cast("long")
        for slot, letter in enumerate(_LETTERS[k * _PER_LONG:(k + 1) * _PER_LONG]):
            bits = F.call_function("shiftleft", F.lit(1).cast("long"), F.least(_times(text, letter), F.lit(_DEEP))) - 1
            part = part.bitwiseOR(F.shiftleft(bits, slot * _DEEP))
        longs.append(part.alias(f"m{k}"))
    more = sum((F.greatest(_times(text, x) - _DEEP, F.lit(0)) for x in _LETTERS), F.lit(0))
    return F.struct(F.length(text).alias("n"), F.left(text, F.lit(BOOST_CHARS)).alias("first"), more.alias("more"), *longs)


def _bound(a: Column, b: Column, letters: bool = True) -> Column:
    """No Jaro-Winkler similarity of two texts with these signatures is higher: as if all letters that both have (all of
    the shorter one without ``letters``) were in reach and in order, with the prefix that they do share."""
    shorter, longer = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    common = shorter
    if letters:
        shared = sum((F.bit_count(a[f"m{k}"].bitwiseAND(b[f"m{k}"])) for k in range(_LONGS)), F.least(a["more"], b["more"]))
        common = F.least(shorter, shared)
    prefix = sum((F.when((shorter >= k) & (F.left(a["first"], F.lit(k)) == F.left(b["first"], F.lit(k))), 1).otherwise(0) for k in range(1, BOOST_CHARS + 1)), F.lit(0))
    jaro = (common / F.greatest(a["n"], F.lit(1)) + common / F.greatest(b["n"], F.lit(1)) + 1) / 3
    jaro = F.when(longer == 0, F.lit(1.0)).when(common == 0, F.lit(0.0)).otherwise(jaro)
    return jaro + BOOST_STEP * prefix * (1 - jaro)


def _ordered_letters(t: Column, often: dict[str, int]) -> Column:
    """The letters of a text, the n-th occurrence of one being a letter of its own, rarest first."""
    def places(x: str) -> Column:
        place = lambda k: F.struct((F.lit(float(often[x])) / k).alias("often"), F.concat(F.lit(x), k.cast("string")).alias("letter"))
        return F.when(_times(t, x) > 0, F.transform(F.sequence(F.lit(1), _times(t, x)), place)).otherwise(F.array())

    return F.array_sort(F.flatten(F.array(*[places(x) for x in _LETTERS])))


def _keyed(titles: DataFrame, need: float) -> DataFrame:
    """``titles`` (t, n, cell, letters) by keys of which two share at least one if their Jaro-Winkler similarity is
    ``need`` or more.

    Either they begin with the same three letters, which is a key, or at most two letters are a boost, so their
    Jaro similarity is at least ``jaro``; then the letters in common, over either length, add up to ``share``. Letters are
    put in one order: two texts with ``o`` of them in common share one among the first (length - o + 1) of each. ``o`` depends on
    both lengths, so a key also names the cells of both; a text has keys for each cell of a partner.
    """
    jaro = (need - 2 * BOOST_STEP) / (1 - 2 * BOOST_STEP)
    share = 3 * jaro - 1
    low = [math.ceil(_RATIO ** c) for c in range(_CELLS)]
    partners = F.array(*[
        F.struct(F.lit(c).alias("other"), F.lit(float(x)).alias("low"), F.lit(float(y)).alias("high")) for c, (x, y) in enumerate(zip(low, [*low[1:], 1 << 40]))
    ])
    overlap = F.lit(share) * F.col("n") * F.col("low") / (F.col("n") + F.col("low"))
    # A text meets the few cells of lengths that can have so much in common with it.
    met = titles.select("*", F.inline(partners)).filter(
        (F.col("low") * (share - 1) <= F.col("n")) & (F.col("n") * (share - 1) <= F.col("high")) & (overlap <= F.col("high"))
    )
    first = F.slice("letters", 1, F.greatest(F.col("n") - F.ceil(overlap - 1e-9).cast("int") + 1, F.lit(0)))
    by_letter = met.select("t", "s", F.least("cell", "other").alias("x"), F.greatest("cell", "other").alias("y"), F.explode(first).alias("l")).select(
        "t", "s", F.concat_ws(":", "l.letter", "x", "y").alias("key")
    )
    return by_letter.unionByName(titles.filter("n >= 3").select("t", "s", F.concat(F.lit("3:"), F.left("t", F.lit(3))).alias("key")))


def title_links(titles: DataFrame, *, need: float) -> DataFrame:
    """(a, b, title_score) of the distinct titles ``titles`` (t), a < b, whose similarity is ``need`` or more: candidates share
    a key of an index, bounds by letters leave few of them, those are scored."""
    ensure_checkpoint_dir(titles.sparkSession)
    counts = titles.agg(*[F.sum((_times(F.col("t"), x) > 0).cast("int")).alias(f"c{i}") for i, x in enumerate(_LETTERS)]).first()
    often = {x: counts[i] or 0 for i, x in enumerate(_LETTERS)}
    n = F.length("t")
    cell = F.when(n < 1, 0).otherwise(sum((F.when(n >= math.ceil(_RATIO ** c), 1).otherwise(0) for c in range(1, _CELLS)), F.lit(0)))
    signed = titles.select("t", _signature(F.col("t")).alias("s"), n.alias("n"), cell.alias("cell"), _ordered_letters(F.col("t"), often).alias("letters")).checkpoint()
    keyed = _keyed(signed, need)
    a, b = (keyed.select("key", F.col("t").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    near = a.join(b, "key").filter((F.col("a") < F.col("b")) & (_bound(F.col("sa"), F.col("sb")) >= need - 1e-9)).select("a", "b").distinct()
    near = near.checkpoint()  # else the filter on the score would be evaluated before the distinct
    return near.withColumn("title_score", jaro_winkler_column("a", "b")).filter(F.col("title_score") >= need - 1e-9)


def candidate_pairs(sv: DataFrame, *, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """Candidates (a_id < b_id), all pairs that can reach ``threshold`` among them.

    Proofs: without a description on both sides a pair has at most the weights of title and time. Pairs with a time bonus lie in
    one cell of 72 hours or in neighbouring ones. Pairs without it need a title similarity of (threshold -
    weight of the description) / weight of the title, and come from an index over distinct titles. In either
    case lengths, letters in common and first letters bound the score before any text is compared.
    """
    need = (threshold - DESCRIPTION_WEIGHT) / TITLE_WEIGHT
    if not BOOST_FROM <= need <= 1:
        raise ValueError("the index needs a threshold that asks for a title similarity between 0.7 and 1")
    rows = sv.select(
        "id", fuzzy_text(F.col("title")).alias("t"), fuzzy_text(F.col("description")).alias("d"), F.unix_millis("published_at").alias("at"),
    )
    if TITLE_WEIGHT + TIME_WEIGHT < threshold:
        rows = rows.filter("d <> ''")
    rows = rows.withColumns({"ts": _signature(F.col("t")), "ds": F.struct(F.length("d").alias("n"), F.left("d", F.lit(BOOST_CHARS)).alias("first"))})
    ensure_checkpoint_dir(sv.sparkSession)
    rows = rows.checkpoint()  # signatures are made once, for both sides of both joins
    a, b = (rows.select(*[F.col(c).alias(f"{x}_{c}") for c in rows.columns]) for x in "ab")
    hours = F.floor(F.abs(F.col("a_at") - F.col("b_at")) / 3_600_000)
    bonus = F.coalesce(F.when(hours <= TIME_BONUS_HOURS, TIME_WEIGHT * (1 - hours / TIME_BONUS_HOURS)), F.lit(0.0))
    described = F.when((F.col("a_d") != "") & (F.col("b_d") != ""), _bound(F.col("a_ds"), F.col("b_ds"), letters=False)).otherwise(0.0)
    ids = [F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")]

    width = TIME_BONUS_HOURS * 3_600_000
    left = a.withColumn("cell", F.floor(F.col("a_at") / width))
    right = b.withColumn("own", F.floor(F.col("b_at") / width)).withColumn("cell", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    title = F.when(F.col("a_t") == F.col("b_t"), F.lit(1.0)).otherwise(_bound(F.col("a_ts"), F.col("b_ts")))
    timely = left.join(right, "cell").filter(
        ((F.col("own") < F.col("cell")) | (F.col("a_id") < F.col("b_id"))) & (bonus > 0)
        & (TITLE_WEIGHT * title + DESCRIPTION_WEIGHT * described + bonus >= threshold - 1e-9)
    ).select(*ids)

    titles = rows.select("t").distinct()
    links = title_links(titles, need=need).checkpoint()
    links = links.unionByName(titles.select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("title_score")))
    apart = a.join(links, F.col("a_t") == F.col("a")).join(b, F.col("b_t") == F.col("b")).filter(
        ((F.col("a_t") != F.col("b_t")) | (F.col("a_id") < F.col("b_id")))
        & (TITLE_WEIGHT * F.col("title_score") + DESCRIPTION_WEIGHT * described + bonus >= threshold - 1e-9)
    ).select(*ids)
    return timely.unionByName(apart).distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component), the component being its lowest id; vertices without edges stand alone.

    Every round takes the lowest label among the neighbours and then the label of that label, so long
    chains halve. Labels are checkpointed to the shared folder: the plan stays short and a lost
    executor does not undo earlier rounds. A hub vertex only meets partial minima.
    """
    ensure_checkpoint_dir(vertices.sparkSession)
    both = edges.select(F.col("a_id").alias("from"), F.col("b_id").alias("to"))
    both = both.unionByName(both.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct().checkpoint()
    labels = vertices.select("id", F.col("id").alias("component")).checkpoint()
    while True:
        near = (
            both.join(labels, both["to"] == labels["id"]).groupBy(F.col("from").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, "id", "left").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("step")
        )
        jump = labels.select(F.col("id").alias("step"), F.col("component").alias("jump"))
        moved = lowered.join(jump, "step", "left").select(
            "id", "old", F.least("step", "jump").alias("component")
        ).checkpoint()
        labels = moved.select("id", "component")
        if moved.filter(F.col("component") != F.col("old")).isEmpty():
            return labels
