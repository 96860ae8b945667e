"""Option values as text, read the same way everywhere."""

from __future__ import annotations


def strings(value: str) -> list[str]:
    """Comma-separated values, trimmed, blank ones left out."""
    return [v.strip() for v in value.split(",") if v.strip()]


def ints(value: str) -> list[int]:
    """Different whole numbers in ascending order; raises ValueError for none."""
    found = sorted({int(v) for v in strings(value)})
    if not found:
        raise ValueError("at least one number is needed")
    return found


def floats(value: str) -> list[float]:
    return [float(v) for v in strings(value)]


def windows(value: str) -> list[int]:
    """ints() that are all positive."""
    found = ints(value)
    if found[0] < 1:
        raise ValueError("windows must be positive")
    return found


def truthy(value: str | None) -> bool:
    """Whether a switch given as text is on."""
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


def bounded_int(value: str | None, default: int, least: int, most: int) -> int:
    """A whole number kept within bounds; `default` for what is none."""
    try:
        found = int((value or "").strip())
    except ValueError:
        found = default
    return max(least, min(most, found))
