"""The store decision of sparse ingestion: the state of one source and what a received row makes of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from vidmetrics.schemas import MONOTONE, USEFUL

DAY_MS = 86_400_000


@dataclass(frozen=True)
class SparseRules:
    """Thresholds of the store decision (fixed defaults: 10 views, 1 %, one point per day)."""

    min_abs: int = 10
    min_rel: float = 0.01
    daily_guard: bool = True

    def significant(self, old: int | None, new: int | None) -> bool:
        """I5."""
        if new is None or old is None:
            return new is not None
        gain = new - old
        if gain <= 0:
            return False
        return gain >= self.min_abs or (old > 0 and gain / old >= self.min_rel)


class SourceState:
    """Last stored point of one source: instant in milliseconds and counters in field order."""

    def __init__(self, fields: Sequence[str], rules: SparseRules, at: int | None = None, values=None):
        self.fields, self.rules = tuple(fields), rules
        self.at, self.values = at, list(values) if values is not None else None
        self._guarded = [i for i, f in enumerate(self.fields) if f in MONOTONE]
        self._watched = [i for i, f in enumerate(self.fields) if f in USEFUL]
        self._views = self.fields.index("views_native")

    def copy(self) -> SourceState:
        return SourceState(self.fields, self.rules, self.at, self.values)

    def merged(self, received: Sequence[int | None]) -> tuple[list, int]:
        """The counters that ``received`` gives over the state, and how many of them were held up."""
        old = self.values
        merged = [o if r is None else r for r, o in zip(received, old)]
        corrections = 0
        for i in self._guarded:
            if old[i] is not None and merged[i] < old[i]:
                merged[i] = old[i]
                corrections += 1
        return merged, corrections

    def decide(self, at: int, received: Sequence[int | None]) -> tuple[bool, str, int, int | None, list]:
        """(stored, reason, corrections, views delta, merged counters); the state follows."""
        if self.at is None:
            self.at, self.values = at, list(received)
            return True, "first_snapshot", 0, None, self.values
        old = self.values
        if at < self.at:
            return False, "out_of_order", 0, None, list(received)
        merged, corrections = self.merged(received)
        was, now = old[self._views], merged[self._views]
        delta = max(0, now - was) if was is not None and now is not None else None
        if at == self.at:
            reason = "same_timestamp_update"
        elif any(merged[i] != old[i] for i in self._watched):
            reason = "useful_metric_changed"
        elif self.rules.significant(was, now):
            reason = "views_delta"
        elif self.rules.daily_guard and at // DAY_MS != self.at // DAY_MS:
            reason = "daily_guard"
        else:
            return False, "below_threshold", corrections, delta, merged
        self.at, self.values = at, merged
        return True, reason, corrections, delta, merged
