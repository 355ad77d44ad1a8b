"""Writers and the read-through store of stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _quoted(text: Column) -> Column:
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), text, F.lit('"'))


def n_triples(rows: DataFrame) -> DataFrame:
    """value: one N-Triples line per row of s, p, o, o_kind, o_type."""
    iri = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))
    literal = F.concat(_quoted(F.col("o")), F.when(F.col("o_type").isNotNull(), F.concat(F.lit("^^<"), "o_type", F.lit(">"))).otherwise(""))
    return rows.select(F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("o_kind") == "literal", literal).otherwise(iri("o")), F.lit(".")).alias("value"))


def write_triples(rows: DataFrame, path: str) -> None:
    n_triples(rows).write.mode("overwrite").text(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated files with a header."""
    rows.write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def write_matrix(scores: DataFrame, path: str, names: list[str]) -> None:
    """A matrix i, j, score as comma-separated rows, one column per name; the names bound the columns."""
    wide = scores.groupBy("i").pivot("j", names).agg(F.first("score"))
    wide.orderBy("i").write.mode("overwrite").csv(path, header=True)


def append_lines(rows: DataFrame, path: str) -> None:
    """Add the texts of the column `value` to a folder of text files."""
    rows.select("value").write.mode("append").text(path)


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and the whole row as JSON text; nulls are kept."""
    return rows.select(*keys, F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"}).alias("json"))


def network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind and json of the nodes (id, label) and edges (src, label, dst) for a network viewer."""
    shown = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "label")).alias("json"))
    return shown.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "label")).alias("json")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage was written to its end."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, bool]:
    """(table, whether it was read): a stage is made and written once, and read ever after unless forced."""
    if not force and exists(spark, path):
        return spark.read.parquet(path), True
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False
