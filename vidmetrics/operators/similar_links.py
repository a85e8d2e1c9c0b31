"""Links of similar sources from classes of equal texts: counts per source and groups without pairs of sources, and the pairs.

Sources of equal title and description are one class. Whether two sources link depends on their classes and, where the texts
alone do not reach the threshold, on the hours between them. So links are found between classes, and counted by the sorted
instants of a class: k copies cost k rows, not k * k pairs. No link is lost. Where the pairs themselves are wanted, links of
classes are made into pairs of sources last, by chunks of their members.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.functions.text import fuzzy_text
from vidmetrics.operators.similarity import (
    BOOST_CHARS, BOOST_STEP, DESCRIPTION_WEIGHT, LINK_THRESHOLD, TIME_BONUS_HOURS, TIME_WEIGHT, TITLE_WEIGHT, _bound, _signature,
    components, jaro_winkler, jaro_winkler_column, title_links,
)
from vidmetrics.session import ensure_checkpoint_dir

_HOUR = 3_600_000
_WIDTH = TIME_BONUS_HOURS * _HOUR
#: Rows of a block on either side, blocks' rows in a task's group, entries of a table of counts, scores kept by a worker.
BLOCK, GROUP, ENTRIES, KEPT = 20_000, 200_000, 1_000_000, 2_000_000
#: The same where links of classes are rows: rows of a block on either side, links that a task's group can have. Members of a chunk,
#: pairs of sources that a task makes, about.
PAIR_BLOCK, PAIR_GROUP, CHUNK, PAIR_TASK = 1_000, 4_000_000, 256, 4_000_000
#: Offsets of instants in a block take these bits; three cells of 72 hours take fewer.
_BITS = 31
_scores: dict[str, dict[str, float]] = {}
_held = 0


def _description_scores(a: str, others: list[str], need: float) -> list[float]:
    """The similarities, or 0 where lengths and first letters show that one is below ``need``."""
    global _held
    known = _scores.setdefault(a, {})
    found = [known.get(b) for b in others]
    for place, b in enumerate(others):
        if found[place] is not None:
            continue
        short, long = sorted((len(a), len(b)))
        prefix = next((k for k in range(min(short, BOOST_CHARS)) if a[k] != b[k]), min(short, BOOST_CHARS))
        jaro = (2 + short / long) / 3
        if jaro + BOOST_STEP * prefix * (1 - jaro) < need - 1e-9:
            found[place] = 0.0
            continue
        if _held >= KEPT:
            _scores.clear()
            _held, known = 0, _scores.setdefault(a, {})
        found[place] = known[b] = jaro_winkler(min(a, b), max(a, b))
        _held += 1
    return found


def _cuts(threshold: float) -> np.ndarray:
    """For each number of whole hours the least score of the texts that reaches ``threshold`` with the bonus of these hours."""
    cuts = []
    for hours in range(TIME_BONUS_HOURS):
        bonus = TIME_WEIGHT * (1 - hours / TIME_BONUS_HOURS)
        cut = threshold - bonus
        while cut + bonus >= threshold:
            cut = np.nextafter(cut, -1.0)
        while cut + bonus < threshold:
            cut = np.nextafter(cut, 2.0)
        cuts.append(cut)
    return np.array(cuts)


def _tables(left: pd.DataFrame, right: pd.DataFrame, threshold: float, timed: bool) -> Iterator[tuple]:
    """(rows of ``left``, classes of ``right``, counts, description scores): how many sources of each class of a block link
    with each row, by the texts alone, or only with the bonus if ``timed``."""
    cuts = _cuts(threshold)
    mine = left.groupby(["b", "cell", "i", "j"], sort=False, dropna=False).indices
    theirs = right.groupby(["b", "cell", "i", "j"], sort=False, dropna=False).indices
    least = threshold - (TIME_WEIGHT if timed else 0.0)
    for block in mine.keys() & theirs.keys():
        ours, r = left.iloc[mine[block]], right.iloc[theirs[block]]
        place, descriptions = pd.factorize(r["d"])
        classes = np.zeros(len(descriptions), np.int64)
        classes[place] = r["c"].to_numpy()
        n, names = r["n"].to_numpy(), list(descriptions)
        if timed:
            first = r["at"].min()
            keys = (place.astype(np.int64) << _BITS) | (r["at"].to_numpy() - first)
            order = np.argsort(keys, kind="stable")
            keys, below = keys[order], np.concatenate([[0], np.cumsum(n[order])])
            codes = np.arange(len(descriptions), dtype=np.int64) << _BITS
        else:
            sizes = np.bincount(place, n, len(descriptions)).astype(np.int64)
        step = max(1, ENTRIES // len(descriptions))
        for at in range(0, len(ours), step):
            some = ours.iloc[at:at + step]
            title = some["s"].to_numpy()
            own, texts = pd.factorize(some["d"])
            best = np.zeros(len(texts))
            np.maximum.at(best, own, title)
            need = (least - TITLE_WEIGHT * best) / DESCRIPTION_WEIGHT
            described = np.array([_description_scores(x, names, low) for x, low in zip(texts, need)])[own]
            base = TITLE_WEIGHT * title[:, None] + DESCRIPTION_WEIGHT * described
            if timed:
                x, y = np.nonzero((base < threshold) & (base >= cuts[0]))
                reach = np.searchsorted(cuts, base[x, y], side="right") * _HOUR
                moment = some["at"].to_numpy()[x] - first
                top = (1 << _BITS) - 1
                high = np.searchsorted(keys, codes[y] | np.clip(moment + reach, 0, top))
                low = np.searchsorted(keys, codes[y] | np.clip(moment - reach + 1, 0, top))
                counts = np.zeros(base.shape, np.int64)
                counts[x, y] = below[high] - below[low]
            else:
                counts = np.where(base >= threshold, sizes, 0)
            yield some, classes, counts, described


def _counted(threshold: float, timed: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def count(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"c": [], "at": [], "n": [], "title": [], "description": []})]
        for some, _, counts, described in _tables(left, right, threshold, timed):
            n = counts.sum(axis=1)
            found.append(pd.DataFrame({
                "c": some["c"].to_numpy(), "at": some["at"].to_numpy(), "n": n, "title": n * some["s"].to_numpy(), "description": (counts * described).sum(axis=1),
            })[n > 0])
        return pd.concat(found[1:] or found)

    return count


def _joined(threshold: float, timed: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Links of a block as few edges: each class and the least class that it reaches within the block's table."""
    def join(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        edges: set[tuple[int, int]] = set()
        for some, classes, counts, _ in _tables(left, right, threshold, timed):
            own, names = pd.factorize(some["c"])
            linked = np.zeros((len(names), len(classes)), bool)
            np.logical_or.at(linked, own, counts > 0)
            names, none = names.to_numpy(), np.iinfo(np.int64).max
            up, down = names.copy(), classes.copy()
            while True:
                higher = np.minimum(down, np.where(linked, up[:, None], none).min(axis=0))
                lower = np.minimum(up, np.where(linked, higher[None, :], none).min(axis=1))
                if (higher == down).all() and (lower == up).all():
                    break
                up, down = lower, higher
            edges.update((int(a), int(b)) for a, b in zip([*names, *classes], [*up, *down]) if a != b)
        return pd.DataFrame(sorted(edges), columns=["a_id", "b_id"], dtype="int64")

    return join


def _linked(threshold: float, timed: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The linked classes of a block, a row per pair ``c`` <= ``other``; with the bonus a row per cell of ``c``, some of whose
    instants link."""
    def link(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"c": [], "cell": [], "other": [], "title": [], "description": []})]
        for some, classes, counts, described in _tables(left, right, threshold, timed):
            own = some["c"].to_numpy()
            x, y = np.nonzero((counts > 0) & (own[:, None] <= classes[None, :]))
            rows = pd.DataFrame({"c": own[x], "cell": some["cell"].to_numpy()[x], "other": classes[y], "title": some["s"].to_numpy()[x], "description": described[x, y]})
            found.append(rows.drop_duplicates(["c", "cell", "other"]) if timed else rows)
        return pd.concat(found[1:] or found)

    return link


def _sources(sv: DataFrame) -> DataFrame:
    rows = sv.select("id", fuzzy_text(F.col("title")).alias("t"), fuzzy_text(F.col("description")).alias("d"), F.unix_millis("published_at").alias("at"))
    return rows.groupBy("id", "t", "d", "at").agg(F.count("*").alias("times"))


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"), "title_score")
    return links.unionByName(turned).select("a", "b", F.col("title_score").alias("s")).distinct()


def _near_titles(moments: DataFrame, need: float) -> DataFrame:
    """(a, b, title_score), a <= b: titles of ``need`` or more that have sources in one cell of 72 hours or in neighbouring ones."""
    placed = moments.select("t", "cell").distinct().withColumn("s", _signature(F.col("t"))).checkpoint()
    left = placed.select("cell", F.col("t").alias("a"), F.col("s").alias("sa"))
    right = placed.select(F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"), F.col("t").alias("b"), F.col("s").alias("sb"))
    pairs = left.join(right, "cell").filter(
        (F.col("a") <= F.col("b")) & ((F.col("a") == F.col("b")) | (_bound(F.col("sa"), F.col("sb")) >= need - 1e-9))
    ).select("a", "b").distinct().checkpoint()
    same = F.col("a") == F.col("b")
    other = pairs.filter(~same).withColumn("title_score", jaro_winkler_column("a", "b")).filter(F.col("title_score") >= need - 1e-9)
    return other.unionByName(pairs.filter(same).withColumn("title_score", F.lit(1.0)))


def _blocks(left: DataFrame, right: DataFrame, links: DataFrame, apply: Callable, schema: str, pairs: bool = False) -> DataFrame:
    """``apply`` on blocks of ``left`` (t, d, c, cell, at) and ``right`` (t, d, c, cell, at, n): the rows whose titles link and whose
    cells are equal, by right title, in parts of bounded size on either side; a hot title or cell has many parts. With ``pairs``
    a task's group is bounded by what its blocks can link."""
    place, many = ["b", "cell"], F.lit(float(PAIR_BLOCK if pairs else BLOCK))
    held = right.groupBy(F.col("t").alias("b"), "cell").agg(F.count("*").alias("right"))
    asked = left.groupBy(F.col("t").alias("a"), "cell").agg(F.count("*").alias("left")).join(links, "a").groupBy(*place).agg(F.sum("left").alias("left"))
    sizes = held.join(asked, place).select(
        *place, F.ceil(F.col("right") / many).cast("int").alias("rights"), F.ceil(F.col("left") / many).cast("int").alias("lefts"), (F.col("right") * F.ceil(F.col("left") / many) + F.col("left") * F.ceil(F.col("right") / many)).alias("rows"),
        (F.col("left") * F.col("right")).alias("links"),
    ).checkpoint()
    rows, meetings = (int(x or 0) for x in sizes.agg(F.sum("rows"), F.sum("links")).first())
    groups = max(1, rows // GROUP, meetings // PAIR_GROUP if pairs else 0, sizes.sparkSession.sparkContext.defaultParallelism)
    part = lambda count: F.pmod(F.xxhash64("d", "at"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    l_rows = left.withColumnRenamed("t", "a").join(links, "a").drop("a").join(sizes, place).withColumn("i", part("lefts")).withColumn("j", every("rights"))
    r_rows = right.withColumnRenamed("t", "b").join(sizes, place).withColumn("j", part("rights")).withColumn("i", every("lefts"))
    group = F.pmod(F.xxhash64("b", "cell", "i", "j"), F.lit(groups)).alias("g")
    l_rows = l_rows.select(group, "b", "cell", "i", "j", "c", "d", "at", "s")
    r_rows = r_rows.select(group, "b", "cell", "i", "j", "c", "d", "at", "n").toDF("g", "b", "cell", "i", "j", "c", "d", "at", "n")  # columns of its own
    return l_rows.groupBy("g").cogroup(r_rows.groupBy("g")).applyInPandas(apply, schema)


def _passes(rows: DataFrame, threshold: float, work: Callable, schema: str, pairs: bool = False) -> tuple[DataFrame, DataFrame]:
    """What ``work`` makes of the links by texts alone and of those that need the bonus; ``rows`` (id, t, d, at, c)."""
    need = (threshold - DESCRIPTION_WEIGHT) / TITLE_WEIGHT
    moments = rows.groupBy("t", "d", "c", "at").agg(F.count("*").alias("n")).checkpoint()
    classes = moments.groupBy("t", "d", "c").agg(F.sum("n").alias("n")).withColumns({"cell": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}).checkpoint()
    titles = classes.select("t").distinct()
    same = titles.select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("title_score"))
    links = _both_ways(title_links(titles, need=need).unionByName(same)).checkpoint()
    whole = _blocks(classes.drop("n"), classes, links, work(threshold, False), schema, pairs)
    dated = moments.filter("at is not null").withColumn("cell", F.floor(F.col("at") / _WIDTH))
    near = _both_ways(_near_titles(dated, need - TIME_WEIGHT / TITLE_WEIGHT)).checkpoint()
    spread = dated.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    return whole, _blocks(dated.drop("n"), spread, near, work(threshold, True), schema, pairs)


def _classed(sv: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All sources (id, t, d, at, times: their rows, c: the least id of equal texts), and those that can have links."""
    if not TITLE_WEIGHT + TIME_WEIGHT < threshold <= TITLE_WEIGHT + DESCRIPTION_WEIGHT:
        raise ValueError("links need a description on both sides, and equal texts link: a threshold above 0.7, below 0.9")
    ensure_checkpoint_dir(sv.sparkSession)
    rows = _sources(sv).checkpoint()
    rows = rows.join(rows.groupBy("t", "d").agg(F.min("id").alias("c")), ["t", "d"])
    return rows, rows.filter("d <> '' and id is not null")


def _pairs(links: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The pairs of sources of ``links`` (c, cell, other, other_cell, title, description); ``members`` (c, cell, id, at, times). The members
    of a class and cell are chunks of bounded size, and pairs of chunks are dealt to tasks, so a hot class has many tasks."""
    place = ["c", "cell"]
    each = members.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).checkpoint()
    sizes = each.groupBy(*place).agg(F.count("*").alias("n")).checkpoint()
    part = F.pmod(F.xxhash64("id", "at", "copy"), F.ceil(F.col("n") / CHUNK))
    chunks = each.join(sizes, place).groupBy(*place, part.alias("i")).agg(F.collect_list(F.struct("id", "at")).alias("left")).checkpoint()
    theirs = lambda df: df.withColumnsRenamed({"c": "other", "cell": "other_cell", "n": "m", "i": "j", "left": "right"})
    other = ["other", "other_cell"]
    total = links.join(sizes, place).join(theirs(sizes), other).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, int(total) // PAIR_TASK)
    met = links.join(chunks, place).join(theirs(chunks), other).filter((F.col("c") != F.col("other")) | (F.col("i") <= F.col("j")))
    met = met.withColumn("one", (F.col("c") == F.col("other")) & (F.col("i") == F.col("j"))).repartition(tasks, *place, "i", *other, "j")
    met = met.select("title", "description", "one", "right", F.explode("left").alias("x")).select("title", "description", "one", "x", F.explode("right").alias("y"))
    met = met.filter(F.when(F.col("one"), F.col("x.id") < F.col("y.id")).otherwise(F.col("x.id") != F.col("y.id")))
    hours = F.floor(F.abs(F.col("x.at") - F.col("y.at")) / _HOUR)
    bonus = F.coalesce(F.when(hours <= TIME_BONUS_HOURS, TIME_WEIGHT * (1 - hours / TIME_BONUS_HOURS)), F.lit(0.0))
    total = TITLE_WEIGHT * F.col("title") + DESCRIPTION_WEIGHT * F.col("description") + bonus
    return met.filter(total >= threshold).select(
        F.least("x.id", "y.id").alias("a_id"), F.greatest("x.id", "y.id").alias("b_id"), F.col("title").alias("title_score"),
        F.col("description").alias("description_score"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)).alias("score"),
    )


def linked_pairs(sv: DataFrame, *, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """(a_id, b_id, title_score, description_score, score), a_id < b_id, all pairs of sources that reach ``threshold``."""
    able = _classed(sv, threshold)[1].drop("c").checkpoint()
    # An id of several rows can be the least of several classes, so these have numbers of their own.
    able = able.join(able.select("t", "d").distinct().withColumn("c", F.monotonically_increasing_id()).checkpoint(), ["t", "d"]).checkpoint()
    whole, timed = _passes(able, threshold, _linked, "c long, cell long, other long, title double, description double", pairs=True)
    whole = whole.withColumn("other_cell", F.lit(0).cast("long")).checkpoint()
    near = F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1))
    timed = timed.dropDuplicates(["c", "cell", "other"]).withColumn("other_cell", near).checkpoint()
    members = able.select("c", F.lit(0).cast("long").alias("cell"), "id", "at", "times")
    dated = members.filter("at is not null").withColumn("cell", F.floor(F.col("at") / _WIDTH))
    return _pairs(whole, members, threshold).unionByName(_pairs(timed, dated, threshold))


def source_links(sv: DataFrame, *, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """Links of J16, a row per source: (id, class_id, n_links, title_score, description_score). ``class_id`` is the least id of the sources with the
    same fuzzy texts, ``n_links`` counts the other sources that reach ``threshold`` with this one, copies included; scores are the
    means over these links."""
    rows, able = _classed(sv, threshold)
    schema = "c long, at long, n long, title double, description double"
    whole, timed = _passes(able, threshold, _counted, schema)
    sums = [F.sum(x).alias(x) for x in ("n", "title", "description")]
    whole = whole.groupBy("c").agg(*sums).select("c", F.struct("n", "title", "description").alias("w"))
    timed = timed.groupBy("c", "at").agg(*sums).select("c", "at", F.struct("n", "title", "description").alias("x"))
    # A source meets itself by its texts, with scores of 1.
    able = F.col("id").isNotNull() & (F.col("d") != "")
    total = {k: F.when(able, F.coalesce(f"w.{k}", F.lit(0)) + F.coalesce(f"x.{k}", F.lit(0)) - 1).otherwise(0) for k in ("n", "title", "description")}
    found = rows.join(whole, "c", "left").join(timed, ["c", "at"], "left").select("id", F.col("c").alias("class_id"), *[v.alias(k) for k, v in total.items()])
    mean = lambda k: F.when(F.col("n") > 0, F.col(k) / F.col("n"))
    return found.select("id", "class_id", F.col("n").cast("long").alias("n_links"), mean("title").alias("title_score"), mean("description").alias("description_score"))


def similar_groups(sv: DataFrame, *, threshold: float = LINK_THRESHOLD) -> DataFrame:
    """R8 over the links of J16: (id, component), the least id reachable. Edges join classes, a block gives at most one for each of
    its classes; sources follow their class."""
    rows, able = _classed(sv, threshold)
    able = able.select("id", "t", "d", "at", "c").checkpoint()
    whole, timed = _passes(able, threshold, _joined, "a_id long, b_id long")
    members = able.select("id", F.col("c")).distinct().checkpoint()
    # An id of several rows may lie in several classes, and joins them.
    shared = members.groupBy("id").agg(F.min("c").alias("a_id"), F.max("c").alias("b_id"), F.collect_set("c").alias("all")).filter("a_id <> b_id")
    shared = shared.select("a_id", F.explode("all").alias("b_id")).filter("a_id <> b_id")
    edges = whole.unionByName(timed).unionByName(shared).distinct()
    labels = components(members.select(F.col("c").alias("id")).distinct(), edges).withColumnsRenamed({"id": "c"})
    of_ids = members.join(labels, "c").groupBy("id").agg(F.min("component").alias("component"))
    return sv.select("id").join(of_ids, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
