"""Broadcast of a checked size, and names that no column has."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Up to so many numbers (8 MB) are broadcast; longer lists meet the other side in a shuffle join.
BROADCAST_ROWS = 1_000_000


def small_side(stashed: DataFrame) -> DataFrame:
    """A stashed list of numbers as the right side of a join: broadcast only if its count allows it."""
    return F.broadcast(stashed) if is_small(stashed) else stashed.hint("merge")


def is_small(stashed: DataFrame) -> bool:
    return stashed.count() <= BROADCAST_ROWS


def unused_name(columns: list[str], name: str) -> str:
    """The name, with underscores behind it until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
