"""Parent-child links to full hierarchies by heavy-path decomposition.

1. Pointer doubling finds each node's root and depth and, in the same rounds, its subtree size:
   before round k every open node points to its ancestor 2^k levels up and knows how many nodes lie
   less than 2^k levels below it. Depth d needs log2(d) + 1 rounds.
2. Nodes that never reach a root are in or under a cycle. Doubling them on, the set of nodes pointed
   at shrinks to exactly the cycles' nodes.
3. Each parent's child with the largest subtree continues its chain; all other children start one.
   A path from the root enters at most log2(n) chains, so prefixes of chains are known after at most
   log2(n) joins, and a node's path is the prefix of its chain and a piece of the chain.
4. Numbering nodes in preorder, heavy child first, makes a chain and every subtree an interval:
   the descendants of a node are the nodes whose number is in its interval.

No step collects a node's children in one task: sizes and heavy children are partial aggregates, and
the running totals over siblings are taken in buckets. A chain is gathered as one array, which
is no longer than the longest path that the result itself holds in one value. Each round is
cut into the shared checkpoint folder.

Defined results: a child with several parents keeps the smallest; null ids and links to absent nodes
do not count; repeated nodes and links count once; a node that is its own parent is on a cycle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernelweave.runtime import cut

SIBLINGS_PER_BUCKET = 50_000


def _parents(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, parent (null for roots) of every distinct node."""
    ids = nodes.where(F.col("id").isNotNull()).select("id").distinct()
    up = links.where(F.col("parent").isNotNull() & F.col("child").isNotNull()).groupBy(F.col("child").alias("id")).agg(F.min("parent").alias("parent"))
    return ids.join(up, "id", "left")


def _climb(pointers: DataFrame) -> tuple[DataFrame, int]:
    """Double pointers until no further node finds its root; (state, number of nodes left open)."""
    at_root = F.col("parent").isNull()
    state = cut(
        pointers.select(
            "id", "parent", F.coalesce("parent", "id").alias("up"), F.when(at_root, 0).otherwise(1).cast("long").alias("dist"), at_root.alias("done"), F.lit(1).cast("long").alias("size")
        )
    )
    open_before = -1
    while True:
        open_now = state.where(~F.col("done")).count()
        if open_now in (0, open_before):
            return state, open_now
        open_before = open_now
        gain = state.where(~F.col("done")).groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("gain"))
        grown = state.join(gain, "id", "left").withColumn("size", F.col("size") + F.coalesce("gain", F.lit(0))).drop("gain")
        ahead = state.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = grown.where(~F.col("done")).join(ahead, "up").select("id", "parent", F.col("up2").alias("up"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), "size")
        state = cut(grown.where("done").select("id", "parent", "up", "dist", "done", "size").unionByName(moved))


def _cycles(open_nodes: DataFrame) -> DataFrame:
    """id of the nodes on cycles, among nodes that never reach a root."""
    state, seen = cut(open_nodes.select("id", "up")), -1
    while True:
        targets = state.select(F.col("up").alias("id")).distinct()
        now = targets.count()
        if now == seen:
            return targets
        seen = now
        state = cut(state.join(state.select(F.col("id").alias("up"), F.col("up").alias("up2")), "up").select("id", F.col("up2").alias("up")))


def _chain_heads(tree: DataFrame) -> DataFrame:
    """Add heavy, head and off (position in the chain) to id, parent, root, depth, size."""
    best = tree.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.max(F.struct("size", (-F.col("id")).alias("neg"))).alias("b"))
    heavy = best.select((-F.col("b.neg")).alias("id"), F.lit(True).alias("heavy"))
    state = tree.join(heavy, "id", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    state = cut(state.select("*", F.when(F.col("heavy"), F.col("parent")).otherwise(F.col("id")).alias("head"), F.when(F.col("heavy"), 1).otherwise(0).cast("long").alias("off"), (~F.col("heavy")).alias("done")))
    while state.where(~F.col("done")).limit(1).count():
        ahead = state.select(F.col("id").alias("head"), F.col("head").alias("head2"), F.col("off").alias("off2"), F.col("done").alias("done2"))
        moved = state.where(~F.col("done")).join(ahead, "head")
        moved = moved.select("id", "parent", "root", "depth", "size", "heavy", F.col("head2").alias("head"), (F.col("off") + F.col("off2")).alias("off"), F.col("done2").alias("done"))
        state = cut(state.where("done").select(moved.columns).unionByName(moved))
    return state.drop("done")


def _light_offsets(nodes: DataFrame) -> DataFrame:
    """id, gap of every chain head but the roots: its number less its parent's number.

    Light siblings follow the heavy child's subtree in order of id. Buckets are ranges of ids, so their number
    bears on the work alone and never on the order.
    """
    light = nodes.where(F.col("parent").isNotNull() & ~F.col("heavy"))
    fan, low, high = light.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    buckets = -(-(fan or 0) // SIBLINGS_PER_BUCKET) or 1
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    light = light.select("id", "parent", "size", F.floor((F.col("id") - F.lit(low or 0)) / F.lit(width)).alias("b"))
    within = Window.partitionBy("parent", "b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("parent").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    light = light.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    totals = light.groupBy("parent", "b").agg(F.sum("size").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(across), F.lit(0)))
    heavy = nodes.where("heavy").select("parent", F.col("size").alias("hs"))
    return light.join(totals.select("parent", "b", "base"), ["parent", "b"]).join(heavy, "parent", "left").select("id", (1 + F.coalesce("hs", F.lit(0)) + F.col("base") + F.col("before")).alias("gap"))


def _chains(nodes: DataFrame, intervals: bool) -> DataFrame:
    """One row per chain: head, root, depth, seg (its ids), prefix (path above), first (number of the head)."""
    chains = nodes.groupBy("head").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("off", "id", "size"))), lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("seg"),
        F.min("depth").alias("depth"),
        F.first("root").alias("root"),
        F.min(F.when(F.col("off") == 0, F.col("parent"))).alias("above"),
    )
    gaps = _light_offsets(nodes).select(F.col("id").alias("head"), "gap") if intervals else None
    chains = chains.join(gaps, "head", "left") if intervals else chains.withColumn("gap", F.lit(None).cast("long"))
    place = nodes.select(F.col("id").alias("above"), F.col("head").alias("up_head"), F.col("off").alias("up_off"))
    chains = cut(chains.join(place, "above", "left"))
    start = F.lit(0).cast("long")
    known = cut(chains.where(F.col("above").isNull()).select("head", "root", "depth", "seg", F.lit("").alias("prefix"), start.alias("first")))
    done, rest = known, chains.where(F.col("above").isNotNull())
    while known.limit(1).count():
        up = known.select(F.col("head").alias("up_head"), F.col("seg").alias("up_seg"), F.col("prefix").alias("up_prefix"), F.col("first").alias("up_first"))
        known = cut(
            rest.join(up, "up_head").select(
                "head", "root", "depth", "seg", F.concat("up_prefix", F.array_join(F.slice(F.col("up_seg.id").cast("array<string>"), F.lit(1), (F.col("up_off") + 1).cast("int")), "/"), F.lit("/")).alias("prefix"), (F.col("up_first") + F.col("up_off") + F.col("gap")).alias("first")
            )
        )
        done = done.unionByName(known)
    return done


def resolve_hierarchy(nodes: DataFrame, links: DataFrame, intervals: bool = False) -> DataFrame:
    """node_id, root_id, depth, path, status, and with `intervals` also first, last.

    `nodes` has id, `links` parent and child. Descendants of a node are the nodes of the same root
    whose `first` lies in (first, last] of the node.
    """
    links = links.join(nodes.select(F.col("id").alias("child")).distinct(), "child", "left_semi").join(nodes.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")
    state, n_open = _climb(_parents(nodes, links))
    tree = state.where("done").select("id", "parent", F.col("up").alias("root"), F.col("dist").alias("depth"), "size")
    chains = _chains(_chain_heads(tree), intervals)
    flat = chains.select("root", "depth", "prefix", "seg", "first", F.posexplode("seg").alias("k", "n"))
    path = F.concat("prefix", F.array_join(F.slice(F.col("seg.id").cast("array<string>"), F.lit(1), F.col("k") + 1), "/"))
    extra = [(F.col("first") + F.col("k")).alias("first"), (F.col("first") + F.col("k") + F.col("n.size") - 1).alias("last")] if intervals else []
    out = flat.select(F.col("n.id").alias("node_id"), F.col("root").alias("root_id"), (F.col("depth") + F.col("k")).alias("depth"), path.alias("path"), F.lit("tree").alias("status"), *extra)
    if not n_open:
        return out
    left = state.where(~F.col("done"))
    on = _cycles(left).withColumn("on", F.lit(True))
    void = F.lit(-1).cast("long")
    extra = [void.alias("first"), void.alias("last")] if intervals else []
    bad = left.join(on, "id", "left").select(F.col("id").alias("node_id"), void.alias("root_id"), void.alias("depth"), F.lit("").alias("path"), F.when(F.col("on"), "on_cycle").otherwise("under_cycle").alias("status"), *extra)
    return out.unionByName(bad)


def descendant_rows(tree: DataFrame) -> DataFrame:
    """node_id, below: every node with each of its descendants, from a resolved tree with intervals.

    The numbers within a node's interval are listed and each is looked up by (root, number), so the work is the
    size of the result; a big tree is spread over its numbers.
    """
    wanted = tree.where("last > first").select("root_id", "node_id", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("at"))
    return wanted.join(tree.select("root_id", F.col("first").alias("at"), F.col("node_id").alias("below")), ["root_id", "at"]).select("node_id", "below")


def dropped_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """parent, child, reason of the links that do not count: `absent` where an end has no row, `other parent` where the child keeps a smaller one."""
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    known = links.where("parent IS NOT NULL AND child IS NOT NULL").select("parent", "child").distinct()
    has = lambda c: ids.select(F.col("id").alias(c), F.lit(True).alias(f"has_{c}"))
    met = known.join(has("parent"), "parent", "left").join(has("child"), "child", "left")
    least = met.where("has_parent AND has_child").groupBy("child").agg(F.min("parent").alias("kept"))
    out = met.join(least, "child", "left")
    reason = F.when(F.col("has_parent").isNull() | F.col("has_child").isNull(), "absent").when(F.col("parent") != F.col("kept"), "other parent")
    return out.select("parent", "child", reason.alias("reason")).where("reason IS NOT NULL")


def containment_links(gsm: DataFrame, kinds: DataFrame) -> DataFrame:
    """parent, child of the links whose containment, however written, is a tree kind."""
    kind = F.lower(F.regexp_replace("containment", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    flat = gsm.select(F.col("id").alias("parent"), F.explode("phi").alias("p")).select("parent", F.col("p.content").alias("child"), F.col("p.containment").alias("containment"))
    tree = kinds.where("is_tree").select(kind.alias("kind")).distinct()
    return flat.where(F.col("child").isNotNull()).withColumn("kind", kind).join(tree, "kind", "left_semi").select("parent", "child").distinct()
