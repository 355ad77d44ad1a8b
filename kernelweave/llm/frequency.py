"""Occurrences and record counts of every distinct value, by external sort and run-length scan.

Pairs of value and record id are range-partitioned by (field, value, record) and sorted within the
partitions, spilling as needed. One value's pairs may span many partitions, so no value is ever
gathered in one task, however common it is; equal pairs always meet in one partition, so records
are counted exactly. A scan over the sorted runs emits one row per value and Arrow batch at most,
and these partial runs are summed.

Defined results: nulls are no values; a text without letters and digits has no terms; a record id
that occurs on several rows counts once per value, and rows without an id are one record; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM_PATTERN = r"[\p{L}\p{Nd}]+"


def terms(text: Column) -> Column:
    """Maximal runs of letters and digits, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), F.lower)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False) if len(column) > 1 else np.zeros(0, bool)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        field, value, absent, rec = (batch.column(k) for k in range(4))
        new_value = np.concatenate([[True], _changes(field) | _changes(value)])
        new_pair = new_value | np.concatenate([[True], _changes(absent) | _changes(rec)])
        if last == tuple(c[0].as_py() for c in (field, value, absent, rec)):
            new_pair[0] = False
        last = tuple(c[-1].as_py() for c in (field, value, absent, rec))
        at = np.flatnonzero(new_value)
        seen = np.diff(np.append(at, batch.num_rows))
        recs = np.add.reduceat(new_pair.astype(np.int64), at)
        yield pa.RecordBatch.from_arrays([field.take(pa.array(at)), value.take(pa.array(at)), pa.array(seen, pa.int64()), pa.array(recs, pa.int64())], names=["field", "value", "n", "r"])


def _named(name: str) -> Callable[[Column], Column]:
    """Value -> struct of the field's name and the value; transform would bind a second parameter to the index."""
    return lambda v: F.struct(F.lit(name).alias("field"), v.alias("value"))


def value_counts(df: DataFrame, record: str, values: dict[str, Column]) -> DataFrame:
    """field, value, occurrences, records of every distinct value.

    `values` maps a field's name to an array column of its values in a row.
    """
    pairs = F.concat(*[F.transform(F.coalesce(c, F.array().cast("array<string>")), _named(name)) for name, c in values.items()])
    key = F.col(f"`{record}`")
    whole = df.select(key).schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rec = F.coalesce(key.cast("long"), F.lit(0).cast("long")) if whole else F.coalesce(key.cast("string"), F.lit(""))
    flat = df.select(key.isNull().alias("absent"), rec.alias("rec"), F.explode(pairs).alias("p")).select("p.field", "p.value", "absent", "rec").where(F.col("value").isNotNull())
    order = ["field", "value", "absent", "rec"]
    ordered = flat.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = ordered.mapInArrow(_scan, "field string, value string, n long, r long")
    return runs.groupBy("field", "value").agg(F.sum("n").alias("occurrences"), F.sum("r").alias("records"))


def mark_extremes(counts: DataFrame, n_rows: int, rare_rows: int = 2, common_share: float = 0.05) -> DataFrame:
    """Add mark: rare, common or null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare_rows, "rare").when(F.col("records") > common_share * n_rows, "common"))
