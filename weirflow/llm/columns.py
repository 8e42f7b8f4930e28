"""Columns that an operator hands through beside its own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def carried(keep: list[str] | None, own: tuple[str, ...] | list[str]) -> tuple[list[Column], list[Column]]:
    """(columns to carry under names of their own, the same columns under their old names at the end).

    A carried column whose name is one of ``own``, in any case, comes back with ``_in`` added to its name until that is free.
    """
    inner, outer, taken = [], [], {x.lower() for x in own}
    for i, name in enumerate(keep or []):
        shown = name
        while shown.lower() in taken:
            shown += "_in"
        taken.add(shown.lower())
        inner.append(F.col(f"`{name}`").alias(f"_carried{i}"))
        outer.append(F.col(f"_carried{i}").alias(shown))
    return inner, outer
