"""The N best rows of every group, by bounds that each block of the input gives for itself.

A block's own N-th best row of a group is a bound: N rows at least as good exist, so no worse row
can be among the group's N best. Each block of an input partition keeps its N best rows of a group and is
then let go, so memory is bounded by the block; the best bound of all blocks is joined to the group, rows
beyond it are dropped, and the few survivors are ranked. A group with millions of rows sends N rows per
block, never its rows.

Rank order is a struct compared in ascending order, so ties are settled by the later fields and at
last by the item's id. Whole numbers keep their type and are turned round bit by bit, so no score is
rounded. Defined results: nulls in a rank field come last; a null group key is a group of its own; repeated
items count once, with their best row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.runtime import cut

BLOCK = 200_000


def _local(keys: list[str], order: list[str], item: str, n: int):
    def best(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").drop_duplicates([*keys, item])
        rank = rows.groupby(keys, dropna=False, sort=False).cumcount() + 1
        return rows.assign(local_rank=rank.astype("int64"))[rank <= n]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK:
                yield best(pd.concat(held, ignore_index=True))
                held, size = [], 0
        if held:
            yield best(pd.concat(held, ignore_index=True))

    return scan


def _ascending(value: Column, kind: str, descending: bool) -> Column:
    """The value, or one that orders the other way round; whole numbers by their bits, so that none overflows."""
    if not descending:
        return value
    return F.bitwise_not(value) if kind in ("tinyint", "smallint", "int", "bigint") else -value


def top_n(df: DataFrame, keys: list[str], order: list[tuple[Column, bool]], item: str, n: int) -> DataFrame:
    """keys, item and rank of the n best distinct items per group; order holds (number, descending)."""
    kinds = [df.select(value.alias("v")).schema["v"].dataType.simpleString() for value, _ in order]
    cols = [F.col(k) for k in keys]
    for k, ((value, descending), kind) in enumerate(zip(order, kinds, strict=True)):
        cols += [value.isNull().cast("int").alias(f"o{k}_null"), F.coalesce(_ascending(value, kind, descending), F.lit(0).cast(kind)).alias(f"o{k}")]
    names = [f"o{k}{x}" for k in range(len(order)) for x in ("_null", "")] + [item]
    source = df.select(*cols, F.col(item))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", local_rank long"
    local = cut(source.mapInPandas(_local(keys, names, item, n), schema))
    badness = F.struct(*names)
    bounds = local.where(F.col("local_rank") == n).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min(badness).alias("bound"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    alive = local.join(bounds, same, "left").select(*local.columns, "bound").where(F.col("bound").isNull() | (badness <= F.col("bound")))
    distinct = alive.groupBy(*keys, item).agg(F.min(badness).alias("badness"))
    ranked = distinct.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("badness")))
    return ranked.where(F.col("rank") <= n).select(*keys, item, "rank")
