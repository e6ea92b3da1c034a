"""Settings with bounds, and page requests; plain values of the driver."""

from __future__ import annotations

from dataclasses import dataclass


def bounded(value, default: int, low: int, high: int) -> int:
    """A number or its text, floored, if it lies within the bounds; else the default."""
    try:
        number = float(value)
    except (TypeError, ValueError):
        return default
    return int(number // 1) if low <= number <= high else default


def page(number: str | None, size: str | None, most: int = 100) -> tuple[int, int]:
    """(offset, limit) of a page request; raises ValueError for anything but digits within 1 to 10,000 and most."""
    def read(text: str | None, default: int, high: int) -> int:
        if text is None:
            return default
        if not (text.isascii() and text.isdigit() and 1 <= int(text) <= high):
            raise ValueError(f"not a number from 1 to {high}: {text!r}")
        return int(text)

    n, k = read(number, 1, 10_000), read(size, 20, most)
    return (n - 1) * k, k


@dataclass(frozen=True)
class Settings:
    publish_least: int = 75
    approve_least: int = 60
    approve_after_hours: int = 24
    most_failures: int = 5
    front_page: int = 20
    ai_per_day: int = 500
    ai_per_source: int = 30
    stale_days: int = 365
    history_days: int = 30

    @classmethod
    def read(cls, rows: dict) -> Settings:
        """From a table of settings, each within its bounds."""
        bounds = {"publish_least": (0, 100), "approve_least": (0, 100), "approve_after_hours": (1, 720), "most_failures": (1, 100), "front_page": (1, 200), "ai_per_day": (0, 100_000), "ai_per_source": (0, 10_000), "stale_days": (1, 3650), "history_days": (1, 365)}
        base = cls()
        return cls(**{k: bounded(rows.get(k), getattr(base, k), *b) for k, b in bounds.items()})
