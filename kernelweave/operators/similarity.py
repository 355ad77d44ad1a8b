"""Scores of stated queries against all rows, alignments and clusterings of a small score matrix.

Queries are few by definition and are broadcast in blocks of checked size; every row meets every query in the
scan, with no shuffle of the rows, and only partial aggregates move. Clusterings work on a matrix whose
size is checked and raise beyond it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERIES_PER_BLOCK = 4096
LARGEST_MATRIX = 4096


def against_all(queries: DataFrame, rows: DataFrame, score: Callable[[Column, Column], Column]) -> DataFrame:
    """Every query with every row and its score, in blocks of queries.

    `queries` has q, q_group, qv and `rows` has r, r_group, rv. The queries of a block travel as one array, so
    the rows are scanned once per block and exploded in place.
    """
    n = queries.count()
    blocks = -(-n // QUERIES_PER_BLOCK)
    held = queries.withColumn("__b", F.pmod(F.xxhash64("q"), F.lit(max(1, blocks)))).groupBy("__b").agg(F.collect_list(F.struct("q", "q_group", "qv")).alias("qs"))
    met = rows.join(F.broadcast(held), F.lit(True)).select("r", "r_group", "rv", F.explode("qs").alias("x"))
    return met.select("x.q", "x.q_group", "r", "r_group", score(F.col("x.qv"), F.col("rv")).alias("score"))


def scaled(df: DataFrame, column: str) -> DataFrame:
    """Column brought to 0..1 by its least and greatest value; 0 where all are equal."""
    ends = df.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return df.join(F.broadcast(ends), F.lit(True)).withColumn(column, F.when(span == 0, F.lit(0.0)).otherwise((F.col(column) - F.col("__lo")) / span)).drop("__lo", "__hi")


def nearest(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Row of best score by keys; the least r among equals."""
    best = scores.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("r")).alias("neg"))).alias("b"))
    return best.select(*keys, (-F.col("b.neg")).alias("r"), F.col("b.score").alias("score"))


def symmetrised(scores: DataFrame) -> DataFrame:
    """i, j, distance: mean of 1 - score in both directions; a missing direction counts as score 0."""
    flat = scores.select("i", "j", "score").unionByName(scores.select(F.col("j").alias("i"), F.col("i").alias("j"), "score"))
    return flat.groupBy("i", "j").agg((1 - F.sum("score") / 2).alias("distance"))


def confusion(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """expected, predicted, n."""
    return df.groupBy(F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(counts: DataFrame) -> DataFrame:
    """class, support, precision, recall, f1 of every class of a confusion table; a ratio without cases is 0."""
    hit = F.when(F.col("expected").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    sides = counts.select(F.explode(F.array(F.struct(F.col("expected").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p"), hit.cast("long").alias("h")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("e")).select("e.*")
    sums = sides.groupBy("class").agg(F.sum("s").alias("support"), F.sum("p").alias("asserted"), F.sum("h").alias("hits"))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    out = sums.withColumns({"precision": ratio(F.col("hits"), F.col("asserted")), "recall": ratio(F.col("hits"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def overall(metrics: DataFrame) -> DataFrame:
    """accuracy and macro and weighted means of precision, recall and f1; macro means run over classes that are expected."""
    n = F.sum("support")
    named = {}
    for m in ("precision", "recall", "f1"):
        named[f"macro_{m}"] = F.avg(F.when(F.col("support") > 0, F.col(m)))
        named[f"weighted_{m}"] = F.sum(F.col(m) * F.col("support")) / n
    return metrics.agg((F.sum("hits") / n).alias("accuracy"), *[c.alias(k) for k, c in named.items()])


def partition_agreement(counts: DataFrame) -> DataFrame:
    """purity and adjusted Rand index of two partitions from their contingency (expected, predicted, n)."""
    pairs = lambda c: (c * (c - 1) / 2)
    by = lambda c: counts.groupBy(c).agg(F.sum("n").alias("m"))
    whole = counts.agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("both"))
    rows = by("expected").agg(F.sum(pairs(F.col("m"))).alias("a"))
    cols = by("predicted").agg(F.sum(pairs(F.col("m"))).alias("b"))
    top = counts.groupBy("predicted").agg(F.max("n").alias("t")).agg(F.sum("t").alias("top"))
    one = whole.join(rows, F.lit(True)).join(cols, F.lit(True)).join(top, F.lit(True))
    chance = F.col("a") * F.col("b") / pairs(F.col("n"))
    spread = (F.col("a") + F.col("b")) / 2 - chance
    return one.select((F.col("top") / F.col("n")).alias("purity"), F.when(spread == 0, F.lit(1.0)).otherwise((F.col("both") - chance) / spread).alias("adjusted_rand"))


def cluster_distances(counts: DataFrame) -> DataFrame:
    """expected, predicted, distance of clusters that share members: size of the symmetric difference over that of the union; from counts, no member lists."""
    whole_a = F.sum("n").over(Window.partitionBy("expected"))
    whole_b = F.sum("n").over(Window.partitionBy("predicted"))
    union = F.col("a") + F.col("b") - F.col("n")
    return counts.withColumns({"a": whole_a, "b": whole_b}).select("expected", "predicted", ((union - F.col("n")) / union).alias("distance"))


def silhouette(distances: DataFrame) -> DataFrame:
    """q, a, b, silhouette from sums of distances: `distances` has q, own (whether the group is the query's), n, total by group; the query itself is no member."""
    mean = F.col("total") / F.nullif(F.col("n"), F.lit(0))
    out = distances.groupBy("q").agg(F.max(F.when(F.col("own"), mean)).alias("a"), F.min(F.when(~F.col("own"), mean)).alias("b"))
    return out.select("q", "a", "b", F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def label_thresholds(scores: DataFrame) -> DataFrame:
    """lower, upper: greatest score of a pair known to conflict and least score within clusters, the lower raised to no more than the upper.

    `scores` has score, same (one cluster) and conflicts.
    """
    upper, lower = F.min(F.when(F.col("same"), F.col("score"))), F.max(F.when(F.col("conflicts"), F.col("score")))
    return scores.agg(F.least(lower, upper).alias("lower"), F.greatest(lower, upper).alias("upper"))


def matrix(distances: DataFrame) -> tuple[list, np.ndarray]:
    """Names in order and the square matrix of i, j, distance; missing cells are the greatest distance. Raises beyond the bound."""
    names = [r[0] for r in distances.select("i").union(distances.select("j")).distinct().orderBy("i").limit(LARGEST_MATRIX + 1).collect()]
    if len(names) > LARGEST_MATRIX:
        raise ValueError(f"a matrix of more than {LARGEST_MATRIX} items is beyond the bound")
    at = {n: k for k, n in enumerate(names)}
    cells = distances.collect()
    out = np.full((len(names), len(names)), max((r["distance"] for r in cells), default=0.0))
    np.fill_diagonal(out, 0.0)
    for r in cells:
        if r["i"] != r["j"]:
            out[at[r["i"]], at[r["j"]]] = r["distance"]
    return names, out


def complete_linkage(d: np.ndarray, k: int) -> list[int]:
    """Cluster of every item after merging, least greatest distance first, down to k clusters; ties by position."""
    groups = {i: [i] for i in range(len(d))}
    far = {(i, j): float(d[i, j]) for i in groups for j in groups if i < j}
    while len(groups) > max(1, k):
        (i, j), _ = min(far.items(), key=lambda x: (x[1], x[0]))
        groups[i] += groups.pop(j)
        far = {p: v for p, v in far.items() if j not in p}
        for m in groups:
            if m != i:
                far[min(i, m), max(i, m)] = float(d[np.ix_(groups[i], groups[m])].max())
    label = [0] * len(d)
    for c, g in enumerate(sorted(groups.values(), key=min)):
        for x in g:
            label[x] = c
    return label


def k_medoids(d: np.ndarray, k: int) -> list[int]:
    """Medoid of every item: start from the most central items, then swap while the total distance falls; ties by position."""
    n = len(d)
    medoids = list(map(int, np.argsort(d.sum(axis=1), kind="stable")[: min(k, n)]))
    cost = lambda m: float(d[:, m].min(axis=1).sum())
    best = cost(medoids) if n else 0.0
    while True:
        swaps = [(cost([*medoids[:i], x, *medoids[i + 1 :]]), i, x) for i in range(len(medoids)) for x in range(n) if x not in medoids]
        low = min(swaps, default=(best, -1, -1))
        if low[0] >= best - 1e-12:
            break
        best, medoids[low[1]] = low[0], low[2]
    return [medoids[int(c)] for c in np.argmin(d[:, medoids], axis=1)] if n else []


def markov_clusters(similarity: np.ndarray, inflation: float, rounds: int = 200) -> list[int]:
    """Attractor of every item in the flow of a column-normalised similarity, expanded and inflated until it stands still."""
    flow = similarity + np.eye(len(similarity))
    flow = flow / flow.sum(axis=0)
    for _ in range(rounds):
        grown = np.linalg.matrix_power(flow, 2) ** inflation
        grown = grown / grown.sum(axis=0)
        if np.abs(grown - flow).max() < 1e-9:
            break
        flow = grown
    return [int(x) for x in np.argmax(flow, axis=0)]
