"""Duration strings ("15min", "1D8H") and the feature-name grammar built on them."""

from __future__ import annotations

import re
from dataclasses import dataclass

MICROS = 1_000_000
DAY_US = 86_400 * MICROS

# Unit spellings and their length in seconds. "M" (month), "W" and larger units have no
# fixed bin anchor at midnight, so they are rejected rather than guessed.
UNIT_SECONDS = {
    "D": 86_400, "d": 86_400, "day": 86_400, "days": 86_400,
    "H": 3_600, "h": 3_600, "hour": 3_600, "hours": 3_600,
    "min": 60, "m": 60, "T": 60, "minute": 60, "minutes": 60,
    "S": 1, "s": 1, "sec": 1, "second": 1, "seconds": 1,
}

# Calendar feature names.
CALENDAR = ("month", "day", "weekday", "hour", "minute")

_TERM = re.compile(r"(\d*)([A-Za-z]+)")


def seconds(duration: str | int) -> int:
    """Length of a duration in whole seconds; ints are taken as seconds already."""
    if isinstance(duration, int):
        if duration <= 0:
            raise ValueError(f"duration must be positive: {duration}")
        return duration
    text = duration.replace(" ", "")
    total, position = 0, 0
    for term in _TERM.finditer(text):
        if term.start() != position or term.group(2) not in UNIT_SECONDS:
            raise ValueError(f"not a fixed duration: {duration!r}")
        total += int(term.group(1) or 1) * UNIT_SECONDS[term.group(2)]
        position = term.end()
    if position != len(text) or total <= 0:
        raise ValueError(f"not a fixed duration: {duration!r}")
    return total


def micros(duration: str | int) -> int:
    return seconds(duration) * MICROS


@dataclass(frozen=True)
class Feature:
    """One requested feature: a calendar part, a history value, or a raw column passed through."""

    name: str
    kind: str  # "calendar" | "history" | "raw"
    shift: int = 0  # seconds
    window: int | None = None  # seconds

    def rows_back(self, step: int) -> int:
        """How many grid rows before the current one this feature may read."""
        if self.kind != "history" or self.shift % step:
            return 0
        return self.shift // step + (self.window_rows(step) - 1 if self.window else 0)

    def window_rows(self, step: int) -> int:
        return -(-self.window // step)


def canonical(name: str) -> str:
    """Accept the dashed header spelling of history features (``hist-1D8H``)."""
    return name.replace("-", "_") if name.startswith("hist-") else name


def feature(name: str) -> Feature:
    name = canonical(name)
    if name in CALENDAR:
        return Feature(name, "calendar")
    if not name.startswith("hist_"):
        return Feature(name, "raw")
    parts = name.split("_")[1:]
    if len(parts) > 2:
        raise ValueError(f"history features take one shift and at most one window: {name!r}")
    return Feature(name, "history", seconds(parts[0]), seconds(parts[1]) if len(parts) == 2 else None)


def features(names) -> list[Feature]:
    return [feature(n) for n in names]
