"""Spans of detections and their written form, shared by operators 4 and 7."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def written(spans: list[Span], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind in the given order, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2])))


def digest(spans: list[Span], order: dict[str, int]) -> str:
    return hashlib.sha256(written(spans, order).encode()).hexdigest()
