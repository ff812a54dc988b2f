"""Joins that hold when one key has a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1024  # a key is hot beyond total / HOT_PARTS rows, so fewer than HOT_PARTS keys can be hot
BROADCAST_ROWS = 100_000  # a side goes to every task only if it was counted and has no more rows


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most ``rows`` rows; no more than one beyond them is looked at."""
    return df.limit(rows + 1).count() <= rows


def join_counted(big: DataFrame, small: DataFrame, on: list[str], count: str, total: int, at_most: int | None = None, broadcast_rows: int = BROADCAST_ROWS, left: bool = False) -> DataFrame:
    """Inner or left join of ``big`` with ``small``, a table of one row per key and the key's number of rows in ``big``.

    ``at_most`` is a bound of the rows of ``small`` that the caller knows; without one a written ``small`` is counted.
    Where ``small`` has at most ``broadcast_rows`` rows all of it goes to every task and ``big`` is not shuffled.  Beyond that, keys with more
    than ``total / HOT_PARTS`` rows are fewer than ``HOT_PARTS``, whatever the data: that part of ``small`` is broadcast, and rows of ``big``
    with such a key are joined where they lie.  The others meet the rest of ``small`` in a shuffle join, for which Spark may filter
    ``big`` first, and no key of which has more than a ``1 / HOT_PARTS`` part of the rows.  Null keys match nothing and are not shuffled;
    keys of ``big`` that ``small`` lacks must be rare in a left join.
    """
    payload = [c for c in small.columns if c not in on]
    kept = [c for c in big.columns if c not in payload]
    whole = " and ".join(f"`{c}` is not null" for c in on)
    rows, how = big.where(whole).select(*kept), "left" if left else "inner"
    if at_most <= broadcast_rows if at_most is not None else fits(small, broadcast_rows):
        return (big.select(*kept) if left else rows).join(F.broadcast(small), on, how).select(*kept, *payload)
    floor = max(1.0, total / HOT_PARTS)
    hot, cold = small.where(F.col(count) > floor), small.where(F.col(count) <= floor)
    tagged = rows.join(F.broadcast(hot.select(*on, F.lit(True).alias("_hot"))), on, "left")
    met = rows.join(F.broadcast(hot), on).select(*kept, *payload)
    out = met.unionByName(tagged.where("_hot is null").select(*kept).join(cold, on, how).select(*kept, *payload))
    if left:
        out = out.unionByName(big.where(f"not ({whole})").select(*kept, *[F.lit(None).cast(small.schema[c].dataType).alias(c) for c in payload]))
    return out
