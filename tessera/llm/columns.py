"""Column names of our own beside those of a user's table."""

from __future__ import annotations

from collections.abc import Iterable


def free(stem: str, taken: Iterable[str]) -> str:
    """The stem behind as many underscores as no name in ``taken`` begins with (case does not count)."""
    low = [t.lower() for t in taken]
    mark = "_"
    while any(t.startswith(mark) for t in low):
        mark += "_"
    return mark + stem
