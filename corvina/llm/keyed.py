"""Joins of rows with one aggregated row per key that stay even when one key holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this share of all rows, so there are at most 1 / HOT_SHARE hot keys: what is broadcast has that bound.
HOT_SHARE = 1 / 4096
#: Below so many rows a key is no burden for one task at all.
HOT_ROWS = 200_000


def join_keyed(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner", hot_share: float = HOT_SHARE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined (inner or left) with keyed, which has one row per key and in column ``count`` the number of rows of that key.

    Rows of hot keys meet their keyed row by broadcast, in place; all others by Spark's own choice of join. Null keys match
    nothing. Both inputs are read more than once: pass tables or cheap plans."""
    total, most = keyed.agg(F.coalesce(F.sum(count), F.lit(0)), F.coalesce(F.max(count), F.lit(0))).first()
    limit = max(total * hot_share, hot_rows)
    if most <= limit:
        return rows.join(keyed, on, how)
    hot = keyed.filter(F.col(count) > limit)
    cold = keyed.filter(F.col(count) <= limit)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return rows.join(F.broadcast(hot), on, "inner").unionByName(rest)
