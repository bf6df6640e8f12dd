"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least 1/HOT_SHARE of all rows counts as hot; at most HOT_SHARE keys can, which bounds what is broadcast.
HOT_SHARE = 1000


def join_by_share(left: DataFrame, sizes: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with sizes (one row per key, `count` = the rows of left with it): hot keys by broadcast, others by shuffle.

    At most HOT_SHARE keys can hold 1/HOT_SHARE of the rows each, so the broadcast side has a fixed bound at any scale.
    `how` is inner or left; a left join keeps the keys that sizes doesn't have.
    """
    hot = sizes.filter(F.col(count) * HOT_SHARE >= F.lit(total))
    cold = sizes.filter(F.col(count) * HOT_SHARE < F.lit(total))
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key, how))
