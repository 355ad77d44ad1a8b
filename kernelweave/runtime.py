"""Session helpers shared by all operators: table reads, lineage cuts, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of `spark.checkpoint.dir`; a local folder only where none is set and all executors are this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="kernelweave-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and drop its lineage.

    Used by every iterative operator, so that a lost executor costs a re-read of a file and
    never a replay of all the rounds before.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Mark `df` for broadcast only after counting that it has at most `max_rows` rows.

    The count stops at `max_rows + 1` rows; a larger side is returned unmarked, so that the
    planner shuffles it.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
