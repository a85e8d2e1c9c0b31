"""Near copies by the Jaccard similarity of their word shingles.

The SimHash trie join (``simhash``) links fingerprints of the same shingles at a few differing bits and gives the
first candidates. Near copies whose fingerprints differ in more bits share min-hash bands: texts of similarity s share one of
``BANDS`` band keys with probability 1 - (1 - s^ROWS)^BANDS, which is 0.99994 at 0.8. Every candidate link is checked on the sets
themselves, so texts below the threshold are never linked. A bucket of a band key is not checked as all
its pairs: its texts are first held against one of them, then, where they do not hang together, against
others in turn. What is still apart meets by shingles: sets of a similarity hold so many in common that one lies among the rarest
of both, where rare counts what sets of other groups hold, so a large group of near copies whose changes keep them
apart gives no pairs for what they share. Links join groups, not texts, so a large group of copies has no more of them than it has texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vidmetrics.llm import simhash
from vidmetrics.llm.common import column, connected, first_of_groups, id_and_text, map_arrow, of_keys, saved, utf8

SEED = 42
BANDS, ROWS = 32, 6
#: Rounds in which a bucket's texts meet one of its texts, before those that are still apart meet by rare shingles.
TURNS = 4
#: Sizes of the sets that a shingle is looked up for are told apart by this ratio.
SIZES = 1.02
_PICK = np.random.default_rng(11)
_FLIP = _PICK.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
_TIMES = _PICK.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)


def shingle_set(text: bytes, shingle_words: int) -> np.ndarray:
    """The distinct XXH64 hashes (seed 42) of the word shingles, ascending: A-Z lowered, ASCII white space
    splits; fewer words than a shingle are one shingle, no word is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1:].tolist())
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """The signed key of each band; a key belongs to one band only. No hash: no key."""
    if not len(hashes):
        return []
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 1024):
        np.minimum(least, ((folded[i:i + 1024] ^ _FLIP) * _TIMES).min(1), out=least)
    keys = [xxhash.xxh64_intdigest(least[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sets(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, v: a name of the set, n: its size, keys, fp: the fingerprint), one row per document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = utf8(batch)
            sets = [shingle_set(t, shingle_words) for t in texts]
            fps = np.array([simhash.fingerprint(t, shingle_words) for t in texts], np.uint64)
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            yield {"doc_id": column(batch, "doc_id"), "v": names.view(np.int64), "n": [len(s) for s in sets], "keys": [band_keys(s) for s in sets], "fp": fps.view(np.int64)}

    return map_arrow(id_and_text(docs), work, "doc_id long, v long, n long, keys array<long>, fp long")


def _hashes_of(docs: DataFrame, rows: DataFrame, names: DataFrame, shingle_words: int) -> DataFrame:
    """(v, s: its hashes as bytes) of the sets ``names`` (v), read from the text of one document each."""
    chosen = saved(of_keys(rows.select("v", "doc_id"), names, "v", "left_semi").groupBy("v").agg(F.min("doc_id").alias("doc_id")), "chosen")
    texts = of_keys(id_and_text(docs), chosen.select("doc_id").distinct(), "doc_id", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            sets = [shingle_set(t, shingle_words).tobytes() for t in utf8(batch)]
            yield {"v": np.array([xxhash.xxh64_intdigest(s, SEED) for s in sets], np.uint64).view(np.int64), "s": sets}

    # Rows that share an id may bring other sets of it: the name tells, and equal sets count once.
    made = map_arrow(texts, work, "v long, s binary")
    return saved(made.join(chosen.select("v"), "v", "left_semi").dropDuplicates(["v"]), "shingle-sets")


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows (a, b, la, lb) of ``pairs`` whose sets have a similarity of ``least`` or more."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            a, b = column(batch, "a").to_numpy(), column(batch, "b").to_numpy()
            near = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near[i] = both >= least * (len(x) + len(y) - both)
            yield {"la": column(batch, "la").to_numpy()[near], "lb": column(batch, "lb").to_numpy()[near]}

    one, two = sets.select(F.col("v").alias("a"), F.col("s").alias("x")), sets.select(F.col("v").alias("b"), F.col("s").alias("y"))
    return map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "la", "lb", "x", "y"), work, "la long, lb long")


def _merged(labels: DataFrame, pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``labels`` (v, label) after the links among the candidates ``pairs`` (a, b): each a meets one of its candidates first, then
    all those that are still in another group."""
    pairs = saved(pairs.select("a", "b").distinct(), "candidates")
    for first in (True, False):
        a, b = (labels.select(F.col("v").alias(x), F.col("label").alias(f"l{x}")) for x in "ab")
        apart = pairs.join(a, "a").join(b, "b").filter("la <> lb").select("a", "b", "la", "lb")
        if first:
            apart = apart.groupBy("a").agg(F.min(F.struct("b", "la", "lb")).alias("p")).select("a", "p.*")
        links = _checked(apart, sets, least).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        joined = connected(saved(links, "checked-links")).select(F.col("v").alias("_v"), F.col("label").alias("_label"))
        labels = saved(labels.join(joined, F.col("label") == F.col("_v"), "left").select("v", F.coalesce("_label", "label").alias("label")), "set-labels")
    return labels


def _trie_pairs(rows: DataFrame, errors: int) -> DataFrame:
    """(a, b): names of sets that the SimHash trie join puts together, by links of fingerprints, each named by one of its sets."""
    named = saved(rows.select("fp", "v").distinct(), "set-fingerprints")
    one = saved(named.groupBy("fp").agg(F.min("v").alias("one")), "fingerprint-sets")
    same = named.join(one, "fp").filter("v <> one").select(F.col("v").alias("a"), F.col("one").alias("b"))
    a, b = (one.select(F.col("fp").alias(f"fp_{x}"), F.col("one").alias(x)) for x in "ab")
    links = simhash.links(one.select("fp"), errors=errors).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return same.unionByName(links.join(a, "fp_a").join(b, "fp_b").filter("a <> b").select("a", "b"))


def _whole(x: Column) -> Column:
    """The smallest whole number not below ``x``, but for rounding."""
    return F.ceil(x - 1e-6)


def _rare_pairs(apart: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of the sets ``apart`` (v, n, label) among which are all of other labels with a similarity of ``least`` or more.

    Such sets share ``least`` / (1 + ``least``) of their sizes' sum. In one order of all hashes, the first shared one cannot stand
    so far back in a set that too few follow it. Hashes that only one label holds stand first, then rare ones, and
    a set is looked up by its first hashes only: by fewer, the nearer the sizes of those it looks for are to its own.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {**{c: column(batch, c) for c in ("v", "n", "label")}, "t": [np.frombuffer(s, np.int64) for s in column(batch, "s").to_pylist()]}

    of_sets = map_arrow(apart.join(sets, "v").select("v", "n", "label", "s"), work, "v long, n long, label long, t array<long>")
    hashes = of_sets.select("v", "n", "label", F.explode("t").alias("t"))
    common = hashes.groupBy("t").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    of_set = Window.partitionBy("v")
    at = F.col("n") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("c", "t")) - 1
    share = least / (1 + least)
    first = hashes.join(common.select("t", "c"), "t").select("v", "n", "label", "t", at.alias("at"))
    first = saved(first.filter(F.col("at") <= F.col("n") - _whole(least * F.col("n"))), "first-hashes")

    # The smaller set of a pair needs fewer of its hashes.
    small = first.filter(F.col("at") <= F.col("n") - _whole(2 * share * F.col("n"))).withColumn("cell", F.floor(F.log("n") / np.log(SIZES).item()))
    cells = small.groupBy("t", "cell").agg(
        F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    near_enough = F.col("at") <= F.col("n") - _whole(share * (F.col("n") + F.greatest(F.col("n_low"), least * F.col("n"))))
    looked = first.join(cells, "t").filter("n_low <= n and (low < high or low <> label)").filter(near_enough & (F.col("n_high") >= least * F.col("n") - 1e-6))
    looked = looked.select("t", "cell", "v", "n", "label", "at")
    small = small.select("t", "cell", *[F.col(c).alias(f"{c}_small") for c in ("v", "n", "label", "at")])
    left = F.least(F.col("n") - F.col("at"), F.col("n_small") - F.col("at_small"))
    met = looked.join(small, ["t", "cell"]).filter("label <> label_small and (n_small < n or n_small = n and v_small < v)")
    met = met.filter((left >= _whole(share * (F.col("n") + F.col("n_small")))) & (F.col("n_small") >= least * F.col("n") - 1e-6))
    return met.select(F.col("v").alias("a"), F.col("v_small").alias("b"))


def resembling(docs: DataFrame, *, shingle_words: int = 5, least: float = 0.8, errors: int = 3, turns: int = TURNS) -> DataFrame:
    """(doc_id, component_id), one row per document row.

    Documents link at a Jaccard similarity of ``least`` or more of their sets of word shingles;
    component_id is the smallest doc_id that links reach. Null or wordless texts are all alike. Candidates are the links of the
    SimHash trie at ``errors`` bits, then shared bands.
    """
    rows = saved(_sets(docs, shingle_words), "shingle-names")
    groups = saved(rows.groupBy("v").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "shingle-groups")
    keys = groups.select("v", "n", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size")).filter("low < high")
    members = saved(keys.join(shared, "key").select("key", "v", "n", "size"), "buckets")
    met_by = members.groupBy("v").agg(F.sum("size").alias("met_by"))
    near = saved(_trie_pairs(rows.filter("n > 0"), errors), "trie-links")
    names = members.select("v").union(near.select("a")).union(near.select("b")).distinct()
    sets = _hashes_of(docs, rows, names, shingle_words)

    fits = F.least("n", "n_hub") >= least * F.greatest("n", "n_hub")
    labels = _merged(groups.select("v", F.col("v").alias("label")), near, sets, least)
    for turn in range(turns + 1):
        now = members.join(labels, "v")
        apart = now.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
        open_ = saved(now.join(apart, "key").select("key", "v", "n", "label"), "open-buckets")
        if open_.isEmpty():
            break
        if turn < turns:
            # The first hub shares most bands with others, so that it is the same in all bands and near to most; later ones differ by bucket.
            order = -F.col("met_by") if turn == 0 else F.xxhash64("v", "key", F.lit(turn))
            hubs = (open_.join(met_by, "v") if turn == 0 else open_).groupBy("key").agg(F.min(F.struct(order.alias("o"), "v", "n", "label")).alias("h")).select(
                "key", F.col("h.v").alias("hub"), F.col("h.n").alias("n_hub"), F.col("h.label").alias("label_hub")
            )
            pairs = open_.join(hubs, "key").filter("label <> label_hub").filter(fits).select(F.col("v").alias("a"), F.col("hub").alias("b"))
        else:
            pairs = _rare_pairs(saved(open_.select("v", "n", "label").distinct(), "apart"), sets, least)
        labels = _merged(labels, pairs, sets, least)
    groups = groups.join(labels, "v").select("v", "first_id", "label")
    first = groups.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "v").join(groups.join(first, "label").select("v", "component_id"), "v").select("doc_id", "component_id")


def one_of_each_group(docs: DataFrame, *, shingle_words: int = 5, least: float = 0.8, errors: int = 3) -> DataFrame:
    """The documents of the smallest id of each group of near copies, with all their columns.

    Rows without an id stay. If several rows carry that id, the one whose text has the smallest hash stays.
    """
    return first_of_groups(docs, resembling(docs.filter("doc_id is not null"), shingle_words=shingle_words, least=least, errors=errors))
