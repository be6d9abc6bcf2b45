"""Names for helper columns that no column of the input has."""

from __future__ import annotations


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """One name for each of `wanted`, different from all of `columns` whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
