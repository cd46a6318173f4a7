"""Spans of a text: digests shared by the operators that look for personal data and secrets."""

from __future__ import annotations

import bisect
import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined; code points."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


class Taken:
    """Places that spans already cover; looked up in logarithmic time."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda x: x[1:]):
            if self.starts and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, span: Span) -> bool:
        at = bisect.bisect_left(self.starts, span[2])
        return at > 0 and self.ends[at - 1] > span[1]
