"""Position of a key among sorted splitters, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_below(splitters: list[tuple[int, ...]], *key: Column) -> Column:
    """How many of the sorted ``splitters`` are at or below ``key``, by halving.

    The splitters are a bounded list that travels inside the plan; a row costs one comparison for each
    doubling of their number.
    """
    if not splitters:
        return F.lit(0)
    columns = [F.lit([s[i] for s in splitters]) for i in range(len(key))]

    def reached(index: Column) -> Column:
        """splitters[index] <= key, in the order of tuples."""
        found = F.lit(True)
        for values, own in reversed(list(zip(columns, key))):
            at = F.get(values, index)
            found = (at < own) | ((at == own) & found)
        return found

    steps = [1 << i for i in reversed(range(len(splitters).bit_length()))]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda below, step: F.when(reached(below + step - 1), below + step).otherwise(below),
    )
