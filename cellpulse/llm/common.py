"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000
"""A group with more than 1 / HOT_SHARE of all rows is hot, so there are never more than HOT_SHARE hot groups."""


def whole_text(name: str) -> Column:
    """The text column, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to one row per ``key``; both sides hold every key.

    Rows of a hot group would all meet in one task. There are at most ``HOT_SHARE`` such groups, so their side is
    broadcast; all other groups are joined by an ordinary shuffle.
    """
    is_hot = F.col(size) > total // HOT_SHARE + 1_000
    hot, rest = groups.filter(is_hot), groups.filter(~is_hot)
    new = [c for c in groups.columns if c != key]
    tried = rows.join(F.broadcast(hot), key, "left")
    found = tried.filter(F.col(size).isNotNull())
    others = tried.filter(F.col(size).isNull()).drop(*new).join(rest, key)
    return found.select(*rows.columns, *new).unionByName(others.select(*rows.columns, *new))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
