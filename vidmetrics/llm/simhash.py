"""SimHash near-duplicates: a binary-trie self-join of 64-bit fingerprints.

Fingerprints live in binary tries. A trie is joined with itself by walking pairs of nodes together:
each step adds the bits in which the two nodes differ, and a pair is pruned as soon as it differs in
more bits than allowed. Spark deals the walk out as subtries: a fingerprint enters ``errors + 1``
tries, each with another block of its bits on top, and only the subtries below equal top blocks are
walked. Errors cannot touch all blocks, so each link is found in at least one trie. A subtrie with
very many fingerprints is cut again into pairs of its own subnodes. Inside a task a node is a range of
the sorted fingerprints, so all pairs of a level are walked with a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, connected, first_of_groups, id_and_text, map_arrow, saved, utf8

SEED = 42
BITS = 64
#: A subtrie with more fingerprints is cut into pairs of the nodes this many bits further down.
SPLIT_ABOVE, SPLIT_BITS = 50_000, 8
#: Node pairs walked at once in a task.
PAIRS_AT_ONCE = 1 << 16
#: Fingerprints whose subtries a task walks together, unless a single one has more: a walk holds a count for each bit of each of them.
WALKED_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle_words: int) -> int:
    words = text.lower().split()  # bytes: only A-Z is lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    k = min(shingle_words, len(words))
    starts, ends = (end - size)[: len(words) - k + 1].tolist(), end[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i:i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = 2 * ones > len(h)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, one row per document row.

    A bit is set if it is in over half of the XXH64 hashes (seed 42) of the word shingles, repeats
    included. Fewer words than a shingle: the whole sequence; null or no word: zero.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle_words) for t in utf8(batch)], dtype=np.uint64)
            yield {"doc_id": column(batch, "doc_id"), "fp": fps.view(np.int64)}

    return map_arrow(id_and_text(docs), work, "doc_id long, fp long")


def trie_links(fps: np.ndarray, group: np.ndarray, errors: int, deep: np.ndarray) -> np.ndarray:
    """For sorted (group, fp): the label of each entry, equal within linked entries of a group.

    ``fps`` are uint64, distinct and ascending in a group. ``deep``: bits from the top from which on
    the nodes of an entry's group need no join of their own (64: all do). Every node is joined with
    its sibling, lowest nodes first; pairs of subtrees that already hang together are skipped, so a
    dense cluster needs about one link per node and not all its pairs.
    """
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    ones = np.zeros((BITS, n + 1), np.int32)
    for d in range(BITS):
        np.cumsum((fps >> np.uint64(BITS - 1 - d)).astype(np.int32) & 1, out=ones[d, 1:])
    # Bits that neighbours share from the top; a new group shares none.
    xor = fps[1:] ^ fps[:-1]
    shared = np.full(n - 1, BITS)
    value = xor.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        big = value >= (np.uint64(1) << np.uint64(shift))
        shared[big] -= shift
        value[big] >>= np.uint64(shift)
    shared = np.where(xor == 0, BITS, shared - 1)
    shared[group[1:] != group[:-1]] = -1

    runs = np.cumsum(np.concatenate(([0], (label[1:] != label[:-1]).astype(np.int64))))
    for d in range(BITS - 1, -1, -1):
        split = np.flatnonzero(shared == d)  # the node's left child ends, the right one begins
        split = split[deep[split] > d]
        if not len(split):
            continue
        # The nodes' ranges: as far as neighbours share more than d bits.
        edge = np.flatnonzero(shared < d)
        lo = np.concatenate(([-1], edge))[np.searchsorted(edge, split)] + 1
        hi = np.concatenate((edge, [n - 1]))[np.searchsorted(edge, split)] + 1
        stack = [(np.stack([lo, split + 1, split + 1, hi, np.ones(len(split), np.int64)]), d + 1)]
        while stack:
            pairs, depth = stack.pop()
            if pairs.shape[1] > PAIRS_AT_ONCE:
                stack.append((pairs[:, PAIRS_AT_ONCE:], depth))
                pairs = pairs[:, :PAIRS_AT_ONCE]
            a0, a1, b0, b1, diff = pairs
            open_ = (runs[a0] != runs[a1 - 1]) | (runs[b0] != runs[b1 - 1]) | (label[a0] != label[b0])
            a0, a1, b0, b1, diff = pairs[:, open_]
            single = (a1 - a0 == 1) & (b1 - b0 == 1)
            if single.any():
                i, j = a0[single], b0[single]
                near = np.bitwise_count(fps[i] ^ fps[j]) <= errors
                label = _united(label, i[near], j[near])
                if near.any():
                    runs = np.cumsum(np.concatenate(([0], (label[1:] != label[:-1]).astype(np.int64))))
                a0, a1, b0, b1, diff = (x[~single] for x in (a0, a1, b0, b1, diff))
            if not len(a0) or depth >= BITS:
                continue
            c = ones[depth]
            am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
            below = np.concatenate([
                np.stack([a0, am, b0, bm, diff]), np.stack([am, a1, bm, b1, diff]),
                np.stack([a0, am, bm, b1, diff + 1]), np.stack([am, a1, b0, bm, diff + 1]),
            ], axis=1)
            below = below[:, (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= errors)]
            if below.shape[1]:
                stack.append((below, depth + 1))
    return label


def walks(group: np.ndarray, at_once: int = WALKED_AT_ONCE) -> list[tuple[int, int]]:
    """Ranges of whole runs of equal ``group``, with at most ``at_once`` entries but for a longer run, which has its own."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
    out, start = [], 0
    while start < len(group):
        end = int(ends[max(np.searchsorted(ends, start + at_once, side="right") - 1, np.searchsorted(ends, start, side="right"))])
        out.append((start, end))
        start = end
    return out


def group_links(fps: np.ndarray, group: np.ndarray, errors: int, deep: np.ndarray) -> np.ndarray:
    """``trie_links`` of any number of groups; it holds the bits of a few of them at a time."""
    label = np.arange(len(fps))
    for start, end in walks(group):
        label[start:end] = start + trie_links(fps[start:end], group[start:end], errors, deep[start:end])
    return label


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after the links (i, j): the smallest of those that meet."""
    pairs = np.unique(np.stack([label[i], label[j]]), axis=1)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for a, b in pairs.T.tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    if not root:
        return label
    new = np.arange(len(label))
    for x in list(root):
        new[x] = find(x)
    return new[label]


def links(fps: DataFrame, *, errors: int = 3, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(a, b) of the distinct fingerprints in ``fps`` (fp): links that join exactly those that a chain
    of links with at most ``errors`` differing bits joins; fewer than one per fingerprint and trie."""
    blocks = errors + 1
    width = BITS // blocks
    rotated = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("trie"),
            (F.shiftleft("fp", i * width).bitwiseOR(F.shiftrightunsigned("fp", BITS - i * width)) if i else F.col("fp"))
            .alias("key"),
        ) for i in range(blocks)
    ]))
    entries = fps.select("fp", rotated.alias("r")).select("fp", "r.trie", "r.key")
    entries = entries.withColumn("top", F.shiftrightunsigned("key", BITS - width))
    # At most (errors + 1) * 2^width rows in all, whatever the input: these fit a broadcast.
    crowded = entries.groupBy("trie", "top").count().filter(F.col("count") > split_above).select(
        "trie", "top", F.lit(True).alias("crowded")
    )
    entries = entries.join(F.broadcast(crowded) if width <= 16 else crowded, ["trie", "top"], "left")
    node = F.shiftrightunsigned("key", BITS - width - SPLIT_BITS).bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    near = [x for x in range(1 << SPLIT_BITS) if x.bit_count() <= errors]
    # A pair of nodes is named by its lower and higher node; the lower one shifted keeps names apart.
    pair = F.when(F.col("crowded"), F.transform(
        F.array(*[F.lit(x) for x in near]),
        lambda x: F.least(node, node.bitwiseXOR(x)) * (1 << SPLIT_BITS) + F.greatest(node, node.bitwiseXOR(x)),
    )).otherwise(F.array(F.lit(-1).cast("long")))
    entries = entries.select("trie", "top", F.explode(pair).alias("pair"), "key", "fp")
    # Signed order is no trie order: sort by the unsigned value.
    order = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    dealt = entries.select("trie", "top", "pair", order.alias("order"), "fp").repartition("trie", "top", "pair")
    cross_from = width + SPLIT_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts = [[column(b, c).to_numpy() for c in ("trie", "top", "pair", "order", "fp")] for b in batches]
        if not parts:
            return
        trie, top, pair, order, fp = (np.concatenate(x) for x in zip(*parts))
        at = np.lexsort((order, pair, top, trie))
        trie, top, pair, order, fp = (x[at] for x in (trie, top, pair, order, fp))
        new = (trie[1:] != trie[:-1]) | (top[1:] != top[:-1]) | (pair[1:] != pair[:-1])
        group = np.concatenate(([0], np.cumsum(new)))
        low, high = pair >> SPLIT_BITS, pair & ((1 << SPLIT_BITS) - 1)
        deep = np.where((pair >= 0) & (low != high), cross_from, BITS)
        keys = order.view(np.uint64) ^ np.uint64(1 << 63)
        label = group_links(keys, group, errors, deep)
        linked = np.flatnonzero(label != np.arange(len(label)))
        yield {"a": fp[linked], "b": fp[label[linked]]}

    return map_arrow(dealt, work, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle_words: int = 3, errors: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per document row.

    Fingerprints link at ``errors`` or fewer differing bits; component_id is the smallest doc_id that
    links reach. Equal texts share a fingerprint. Null or wordless texts have fingerprint zero and link
    like any other; a null doc_id is never a component_id while its group has an id. No rows: no rows.
    """
    rows = saved(fingerprints(docs, shingle_words=shingle_words), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = saved(groups, "fingerprint-groups")
    labels = connected(links(groups.select("fp"), errors=errors))
    groups = groups.join(labels, groups["fp"] == labels["v"], "left").select(
        "fp", "first_id", F.coalesce("label", "fp").alias("label")
    )
    first = groups.groupBy("label").agg(F.min("first_id").alias("component_id"))
    of_fp = groups.join(first, "label").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame, *, shingle_words: int = 3, errors: int = 3) -> DataFrame:
    """The documents of the smallest id of each near-duplicate group, with all their columns.

    Rows without an id stay. If several rows carry that id, the one whose text has the smallest hash stays.
    """
    return first_of_groups(docs, near_duplicates(docs.filter("doc_id is not null"), shingle_words=shingle_words, errors=errors))
