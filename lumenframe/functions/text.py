"""Sizes, durations and stamps as text."""

from __future__ import annotations

import re
from datetime import UTC, datetime


def bytes_text(count: float) -> str:
    """With a binary unit and two digits: 1536 -> 1.50 KiB."""
    for unit in ("B", "KiB", "MiB", "GiB"):
        if count < 1024:
            return f"{count:.2f} {unit}"
        count /= 1024
    return f"{count:.2f} TiB"


def seconds_text(seconds: float) -> str:
    """In the largest unit that leaves at least one: 90 -> 1.50 minutes."""
    for unit, size in (("days", 86400.0), ("hours", 3600.0), ("minutes", 60.0)):
        if seconds >= size:
            return f"{seconds / size:.2f} {unit}"
    return f"{seconds:.2f} s" if seconds >= 1 or seconds == 0 else f"{seconds * 1000:.2f} ms"


def duration(text: str | float) -> float:
    """Seconds of '1s', '500ms', '2min' or a number."""
    if not isinstance(text, str):
        return float(text)
    found = re.fullmatch(r"\s*([0-9.]+)\s*(ms|s|min|h)\s*", text)
    if not found:
        raise ValueError(f"no duration: {text!r}")
    return float(found[1]) * {"ms": 0.001, "s": 1.0, "min": 60.0, "h": 3600.0}[found[2]]


def stamp() -> str:
    """Now, as an ISO 8601 text in UTC."""
    return datetime.now(UTC).isoformat()
