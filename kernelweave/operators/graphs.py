"""Graph operators over an edge table: closure, components, levels, removal, contraction, order.

Loops are driven by what is new in a round and cut into the shared checkpoint folder, so a lost executor
re-reads a file. Finished rows leave the loop. Defined results: null ends are no edges; repeated edges
count once; self loops never appear in a result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.runtime import cut


def clean(edges: DataFrame) -> DataFrame:
    """Distinct src, dst without nulls and self loops."""
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    return clean(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


def transitive_closure(edges: DataFrame) -> DataFrame:
    """src, dst of all pairs joined by a path; each round extends only the pairs that the last one found."""
    step = cut(clean(edges))
    known, fresh = step, step
    hop = step.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
    while fresh.limit(1).count():
        reached = fresh.join(hop, "dst").select("src", F.col("far").alias("dst")).where("src <> dst").distinct()
        fresh = cut(reached.join(known, ["src", "dst"], "left_anti"))
        known = cut(known.unionByName(fresh))
    return known


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge.

    Alternating large-star and small-star steps: every edge moves to the smallest node seen from its end, until
    all edges are stars. Minima are partial aggregates, and a round moves each edge once.
    """
    state, before = cut(clean(edges)), None
    while True:
        both = symmetric(state)
        low = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
        large = both.join(low, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
        down = clean(large).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
        least = down.groupBy("src").agg(F.min("dst").alias("low"))
        small = down.join(least, "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))).alias("e")).select("e.*")
        state = cut(clean(small))
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    heads = state.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return state.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(heads)


def bfs_levels(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node, depth: fewest steps from any of `seeds` (node)."""
    step = cut(clean(edges))
    front = cut(seeds.where("node IS NOT NULL").select("node").distinct().withColumn("depth", F.lit(0)))
    done = front
    while front.limit(1).count():
        ahead = front.join(step, front["node"] == step["src"]).select(step["dst"].alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        front = cut(ahead.join(done, "node", "left_anti"))
        done = cut(done.unionByName(front))
    return done


def remove_nodes(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Distinct src, dst without `removed` (node): what led to a removed node leads on to what follows it, through any chain of them."""
    links = cut(clean(edges))
    gone = removed.select("node").distinct()
    to_gone = links.join(gone.select(F.col("node").alias("dst")), "dst", "left_semi")
    front = cut(to_gone.join(gone.select(F.col("node").alias("src")), "src", "left_anti").select("src", "dst"))
    done = cut(links.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    onward = cut(links.join(gone.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("dst"), F.col("dst").alias("far")))
    seen = front
    while front.limit(1).count():
        ahead = front.join(onward, "dst").select("src", F.col("far").alias("dst")).distinct()
        inside = ahead.join(gone.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        done = cut(done.unionByName(ahead.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst").where("src <> dst")))
        front = cut(inside.join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.unionByName(front))
    return done.distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, n_out, n_in of every node."""
    ends = clean(edges).select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    all_ends = ends.unionByName(nodes.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return all_ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def group_order(df: DataFrame, group: str, order_within) -> DataFrame:
    """group, node, rank, level of small graphs, one group's graph at a time.

    `df` has group, src and dst (null for a node without edges). For graphs that one text holds; `order_within`
    is applied to a group's rows as a pandas frame.
    """
    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group).applyInPandas(order_within, f"`{group}` {kind}, node long, rank long, level long")


def topological(group: str):
    """Rows of one graph in topological order, smallest id first among the free ones; level is the longest path from a source.

    Nodes on cycles or after them have neither rank nor level.
    """

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        import heapq

        key = rows[group].iloc[0]
        links = rows.dropna(subset=["dst"])[["src", "dst"]].astype("int64")
        links = links[links.src != links.dst].drop_duplicates()
        nodes = sorted(set(rows.src.astype("int64")) | set(links.dst))
        after: dict[int, list[int]] = {n: [] for n in nodes}
        waits = dict.fromkeys(nodes, 0)
        for a, b in links.itertuples(index=False):
            after[a].append(b)
            waits[b] += 1
        level = {n: 0 for n in nodes if not waits[n]}
        free, out = sorted(level), []
        heapq.heapify(free)
        while free:
            n = heapq.heappop(free)
            out.append(n)
            for m in after[n]:
                waits[m] -= 1
                level[m] = max(level.get(m, 0), level[n] + 1)
                if not waits[m]:
                    heapq.heappush(free, m)
        rank = {n: k for k, n in enumerate(out)}
        found = pd.DataFrame({group: key, "node": nodes})
        found["rank"] = pd.array([rank.get(n) for n in nodes], dtype="Int64")
        found["level"] = pd.array([level[n] if n in rank else None for n in nodes], dtype="Int64")
        return found

    return order


def runs(df: DataFrame, key: str, order: list[str], bucket: Column, value: str) -> DataFrame:
    """Add run: number, from 1, of the run of equal `value` that a row lies in, by key and order.

    Rows are ordered within (key, bucket) only, and one summary row per bucket carries a key's state from
    bucket to bucket, so a hot key is spread over its buckets. `bucket` must not decrease along the order.
    """
    rows = df.withColumn("__b", bucket)
    within = Window.partitionBy(key, "__b").orderBy(*order)
    prior = F.lag(value).over(within)
    rows = rows.withColumn("__c", F.when(F.row_number().over(within) == 1, 0).otherwise((~prior.eqNullSafe(F.col(value))).cast("int")))
    place = F.struct(*order)
    sums = rows.groupBy(key, "__b").agg(F.min_by(F.struct(value), place).alias("f"), F.max_by(F.struct(value), place).alias("l"), F.sum("__c").alias("n"))
    across = Window.partitionBy(key).orderBy("__b")
    last = F.lag("l").over(across)
    sums = sums.withColumn("__s", F.when(last.isNull() | ~last[value].eqNullSafe(F.col("f")[value]), 1).otherwise(0))
    sums = sums.select(key, "__b", (F.sum(F.col("__s") + F.col("n")).over(across) - F.col("n")).alias("__base"))
    return rows.join(sums, [key, "__b"]).withColumn("run", F.col("__base") + F.sum("__c").over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("__b", "__c", "__base")

