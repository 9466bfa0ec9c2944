"""Lookups that stay even when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one row in this many; so there are never more hot keys than this.
SHARE = 1_000


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` joined with ``table``, which holds every key once; ``rows`` should be stored, it is read three times.

    Hot keys are counted first.  There are at most ``SHARE`` of them, so their rows of ``table`` are broadcast
    and the hot rows stay where they are; all others are joined by a shuffle in which no key is hot.
    """
    keys = list(keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.count()
    hot = [tuple(r) for r in counts.filter(F.col("_n") > max(total / SHARE, 1)).select(*keys).collect()]
    if not hot:
        return rows.join(table, keys, how)
    few = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(*keys).schema))
    their = F.broadcast(table.join(few, keys, "left_semi"))
    rest = rows.join(few, keys, "left_anti").join(table, keys, how)
    return rest.unionByName(rows.join(few, keys, "left_semi").join(their, keys, how))
