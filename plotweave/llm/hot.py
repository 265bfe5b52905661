"""Joining rows to one row per key where a few keys may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Keys with more than this part of all rows are joined by broadcast; there are fewer of them than that.
HOT_KEYS = 4096


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of `rows` to `groups`, which has one row per `key` with the number of its rows in `size`.

    Of `total` rows fewer than HOT_KEYS keys can each hold more than one in HOT_KEYS. Those are broadcast, so
    their rows stay where they are; the rows of all other keys are shuffled, none of them a large group.
    """
    hot = groups.filter(F.col(size) * HOT_KEYS > F.lit(total))
    large = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key)
    return large.unionByName(rest)
