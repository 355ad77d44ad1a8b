"""Joins to a keyed side whose keys may be hot, without relying on how the planner treats skew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1024


def attach(rows: DataFrame, keyed: DataFrame, keys: list[str], count_col: str) -> DataFrame:
    """Inner join of `rows` to `keyed` (one row per key, `count_col` = rows of that key).

    Keys that hold more than 1/1024 of all rows are at most 1024, whatever the input's size; only
    these are broadcast, so their rows never meet in one task. All other keys are joined by shuffle.
    Keys must not be null.
    """
    total = keyed.agg(F.sum(count_col)).first()[0]
    if total is None:
        return rows.join(keyed, keys)
    limit = total / HOT_SHARE
    hot = F.broadcast(keyed.where(F.col(count_col) > limit))
    cold = keyed.where(F.col(count_col) <= limit)
    parts = [rows.join(hot, keys), rows.join(hot.select(keys), keys, "left_anti").join(cold, keys)]
    return reduce(DataFrame.unionByName, parts)
