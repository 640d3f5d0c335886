"""Names for helper columns that clash with no column of the user."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def unused(taken: DataFrame | Iterable[str], *names: str) -> list[str]:
    """``names``, each with underscores added until no column in ``taken`` has it (in any case)."""
    used = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out
