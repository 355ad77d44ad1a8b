"""All named queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kernelweave.plans import evaluation, feeds, graph_queries, ingestion, kernel_queries, mentions, reasoning, refinery, strings

MODULES = (refinery, strings, mentions, graph_queries, reasoning, evaluation, ingestion, feeds, kernel_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["p2_found"](spark, sf_dir)
