"""Joins of rows with one row a key where some keys have very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that a join sends to all tasks for their number of rows, and the most rows of a key that is never sent.
HEAVY, LIGHT = 20_000, 100


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key``, one row a key, whose column ``n`` says how many rows the key has.

    Keys with over LIGHT rows and more than one in HEAVY of ``total`` are broadcast, so that their rows stay where they
    are; there are at most HEAVY of them, whatever the size of the input. All other keys are shuffled. ``how`` is inner
    or left. ``per_key`` is read three times and ``rows`` twice.
    """
    bar = max(LIGHT, total // HEAVY)
    hot = F.broadcast(per_key.where(F.col(n) > bar))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(per_key.where(F.col(n) <= bar), keys, how)
    return rows.join(hot, keys).unionByName(rest)
