"""Secret scans over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: text that matches the
rule must satisfy it. Every batch of documents is a segment with an inverted index of the trigrams
that the queries name; postings are intersected and united, and the documents that remain are verified
with the expression itself, over their whole text. Rules without a mandatory trigram verify all
documents. The index ignores the case of A-Z, so it serves rules of either kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmetrics.llm.common import column, id_and_text, map_arrow, map_rows, strings


@dataclass(frozen=True)
class Rule:
    """``least``: (group, fewest characters) that a match must have; others are dropped after matching."""

    kind: str
    pattern: str
    least: tuple[int, int] = (0, 1)
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.A | (re.I if self.any_case else 0))

    def spans(self, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
        group, fewest = self.least
        return [m.span() for m in compiled.finditer(text) if m.end(group) - m.start(group) >= fewest]


# --- fixed values: forms of well-known credentials ----------------------------
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (2, 6), True),
    Rule("access", r"AKIA[A-Z0-9]+", (0, 20)),
    # Runs are maximal either way; asking for 24 at once spares a match for every short run.
    Rule("hex", r"[0-9a-f]{24,}", (0, 24)),
)
# A private key goes to its END line. Where that is missing or another block begins first, it goes over the fields
# and the base64 lines that follow, line ends in escaped form included; a short last line is alone on it or padded.
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----"
_GAP = r"(?:\s|\\[rn])*+"
_UNENDED = (
    r"(?:\s*\n[A-Z][A-Za-z0-9-]*:[^\r\n]*+)*" + rf"(?:{_GAP}[A-Za-z0-9+/]{{24,}}+={{0,2}})+"
    + rf"(?:{_GAP}[A-Za-z0-9+/]++={{1,2}}|\s*\n[A-Za-z0-9+/]++(?=\s*(?:\n|\Z)))?"
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:{_TO_END}|{_UNENDED}|)"),
    Rule("url_login", r"(?<![a-z0-9+.-])[0-9+.-]*+[a-z][a-z0-9+.-]++://[^\s:/@]++:[^\s:/@]++@"),
)
# ------------------------------------------------------------------------------

#: A query: True (no demand), ("and", parts), ("or", parts) or a trigram.
Query = bool | bytes | tuple
#: Strings followed at once while a query is derived, and characters a class may stand for.
MOST_STRINGS, MOST_CHARACTERS = 64, 6


def _all(parts: Sequence[Query]) -> Query:
    parts = tuple(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _any(parts: Sequence[Query]) -> Query:
    parts = tuple(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", parts)


def _demand(texts: set[bytes]) -> Query:
    """Text that contains one of ``texts`` has these trigrams."""
    return _any([_all([t[i:i + 3] for i in range(len(t) - 2)]) for t in sorted(texts)])


def _class(items) -> set[bytes] | None:
    found: set[bytes] = set()
    for op, value in items:
        codes = [value] if op is C.LITERAL else range(value[0], value[1] + 1) if op is C.RANGE else None
        if codes is None or len(codes) > 3 * MOST_CHARACTERS or max(codes) > 127:
            return None
        found |= {bytes([x]).lower() for x in codes}
    return found if len(found) <= MOST_CHARACTERS else None


def _derive(tree) -> tuple[set[bytes] | None, Query]:
    """(the strings that the tree stands for, if they are few; what other text must hold)."""
    demands: list[Query] = []
    now: set[bytes] = {b""}  # what may stand right here, as far as it is known
    exact = True

    def broken() -> None:
        nonlocal now, exact
        demands.append(_demand(now))
        now, exact = {b""}, False

    def follow(texts: set[bytes]) -> None:
        nonlocal now, exact
        if len(now) * len(texts) > MOST_STRINGS:
            demands.append(_demand(now))
            now, exact = {t[-2:] for t in now}, False
            if len(now) * len(texts) > MOST_STRINGS:
                now = {b""}
        now = {a + b for a, b in product(now, texts)}

    for op, value in tree:
        if op is C.LITERAL and value < 128:
            follow({bytes([value]).lower()})
        elif op is C.IN and (texts := _class(value)):
            follow(texts)
        elif op is C.SUBPATTERN:
            texts, query = _derive(value[3])
            if texts is None:
                broken()
                demands.append(query)
            else:
                follow(texts)
        elif op is C.BRANCH:
            parts = [_derive(x) for x in value[1]]
            if all(t is not None for t, _ in parts):
                follow(set().union(*(t for t, _ in parts)))
            else:
                broken()
                demands.append(_any([q if t is None else _demand(t) for t, q in parts]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, item = value
            texts, query = _derive(item)
            if texts is not None and most == 1:
                follow(texts | ({b""} if least == 0 else set()))
            elif least == 0:
                broken()
            elif texts is None:
                broken()
                demands.append(query)
            else:
                for _ in range(min(least, 16)):
                    follow(texts)
                if most != least or least > 16:
                    broken()
        elif op is C.AT:
            continue
        else:  # any character, large classes, look-around, references: no demand
            broken()
    if exact and len(now) <= MOST_STRINGS:
        return now, _demand(now)
    return None, _all([*demands, _demand(now)])


def trigram_query(rule: Rule) -> Query:
    """What a text must hold to match ``rule``; True if nothing is certain."""
    return _derive(_parser.parse(rule.pattern, re.A | (re.I if rule.any_case else 0)))[1]


def _trigrams(query: Query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*map(_trigrams, query[1]))
    return set() if query is True else {query}


class Segment:
    """Inverted index of a batch: for each trigram of a vocabulary the documents that hold it."""

    def __init__(self, texts: list[str], number_of: np.ndarray, vocabulary: dict[bytes, int]):
        self.size, self.vocabulary = len(texts), vocabulary
        raw = [t.encode().lower() for t in texts]
        ends = np.cumsum([len(r) + 1 for r in raw])
        data = np.frombuffer(b"\0".join(raw) + b"\0\0\0", np.uint8).astype(np.uint32)
        number = number_of[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(number)
        pairs = np.unique(number[at].astype(np.int64) * self.size + np.searchsorted(ends, at, side="right"))
        bounds = np.searchsorted(pairs, np.arange(len(vocabulary) + 2) * self.size)
        self.postings = [pairs[a:b] % self.size for a, b in zip(bounds[:-1], bounds[1:])]

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[self.vocabulary[query]]
        found = [self.candidates(q) for q in query[1]]
        merge = np.intersect1d if query[0] == "and" else np.union1d
        out = found[0]
        for x in found[1:]:
            out = merge(out, x)
        return out


#: Characters a segment holds at most, except for a single longer text.
SEGMENT_CHARS = 4_000_000


def _segments(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > SEGMENT_CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, texts[start:]


class Scanner:
    """Finds the spans of all rules in lists of texts."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = [(rule, rule.compiled(), trigram_query(rule)) for rule in rules]
        names = sorted(set().union(*(_trigrams(q) for _, _, q in self.rules)))
        self.vocabulary = {t: i + 1 for i, t in enumerate(names)}
        self.number_of = np.zeros(1 << 24, np.uint16)
        for t, i in self.vocabulary.items():
            self.number_of[int.from_bytes(t, "big")] = i

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text (start, end, kind), by start and then by the order of the rules."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for first, part in _segments(texts):
            index = Segment(part, self.number_of, self.vocabulary)
            for rule, compiled, query in self.rules:
                for i in index.candidates(query).tolist():
                    out[first + i] += [(a, b, rule.kind) for a, b in rule.spans(compiled, part[i])]
        for spans in out:
            spans.sort(key=lambda s: s[0])  # stable: the order of the rules stays
        return out


def find_secrets(docs: DataFrame, *, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row per document row.

    Offsets count code points, ends are exclusive; matches of one kind do not overlap, leftmost first.
    Spans are ordered by start, then by the order of ``rules``. Null or empty texts have no spans.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = Scanner(rules)
        for batch in batches:
            found = scanner.scan(strings(batch))
            yield {
                "doc_id": column(batch, "doc_id"),
                "spans": [[{"kind": k, "start": a, "end": b} for a, b, k in spans] for spans in found],
            }

    return map_arrow(id_and_text(docs), work, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of their spans and the text of all spans."""
    def written(kinds: Sequence[str] | None):
        spans = F.col("spans") if kinds is None else F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = [r.kind for r in BASE_RULES]
    counts = [count(kind) for kind in base]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(None).alias("spans"))


def mask_secrets(docs: DataFrame, *, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``[kind]``; overlapping spans become one, named
    after the first. n_chars, where it exists, is counted anew for changed texts. Other columns, texts
    without secrets and nulls stay as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            sizes = column(batch, "n_chars").to_pylist() if "n_chars" in batch.schema.names else None
            for i, spans in enumerate(scanner.scan([t or "" for t in texts])):
                if not spans:
                    continue
                out, end = [], 0
                for a, b, kind in spans:
                    if a >= end:
                        out += [texts[i][end:a], f"[{kind}]"]
                    end = max(end, b)
                texts[i] = "".join(out) + texts[i][end:]
                if sizes is not None:
                    sizes[i] = len(texts[i])
            made = {n: batch.column(k) for k, n in enumerate(batch.schema.names)} | {"text": texts}
            yield made if sizes is None else made | {"n_chars": sizes}

    return map_rows(docs, work)
