"""What a series is made of, and durations. Nothing here touches Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Microseconds of each unit that a duration may be written in.
UNITS = {"us": 1, "µs": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
_PART = re.compile(r"(\d+(?:\.\d+)?)(us|µs|ms|s|m|h|d|w)")


@dataclass(frozen=True)
class SeriesSpec:
    """Columns of a table of points: its time, its tags and its fields; ``tiebreak`` orders equal times."""

    time: str
    tags: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    tiebreak: tuple[str, ...] = ()

    @property
    def order(self) -> tuple[str, ...]:
        return (self.time, *self.tiebreak)


def duration(text: str | int) -> int:
    """Microseconds of ``90s``, ``1h30m``, ``500ms``, ``2d`` or ``1w``; a whole number is microseconds."""
    if isinstance(text, int):
        return text
    parts = _PART.findall(text)
    if not parts or "".join(n + u for n, u in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * UNITS[u] for n, u in parts)
    if total != int(total):
        raise ValueError(f"finer than a microsecond: {text!r}")
    return int(total)
