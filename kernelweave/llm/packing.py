"""Texts put whole into containers of fixed capacity: dominance reduction, then best fit of the remainder.

Everything is decided on the number of texts of each size, at most one entry per size up to the
capacity, whatever the number of texts. Reduction (Martello and Toth): the largest size whose best
partner is certain, because it fills the container, because no two texts would fit beside it, or because
the partner is at least as large as any two that would, is closed with that partner. What remains is put, in
descending size, where the least space is left. Containers of equal content are kept as one run, so
the plan is a table of runs; texts are numbered within their size and look up their run.

Defined results: a text above the capacity is cut into full pieces and a rest; empty and null texts have size 0
and lie in container 0.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class _Sizes:
    """Counts by size with the sizes in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, k: int) -> None:
        self.n[size] -= k
        if not self.n[size]:
            del self.n[size]
            self.order.pop(bisect_left(self.order, size))

    def largest(self, limit: int) -> int:
        at = bisect_right(self.order, limit)
        return self.order[at - 1] if at else 0

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for s in self.order:
            out += [s] * min(self.n[s], k - len(out))
            if len(out) == k:
                break
        return out

    def best_pair(self, limit: int) -> int:
        best, lo, hi = 0, 0, len(self.order) - 1
        while lo <= hi:
            total = self.order[lo] + self.order[hi]
            if total > limit or (lo == hi and self.n[self.order[lo]] < 2):
                hi -= 1
            else:
                best, lo = max(best, total), lo + 1
        return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(containers closed for certain as (sizes, number), counts of the remainder)."""
    left, closed = _Sizes(counts), []
    for size in sorted(counts, reverse=True):
        while size in left.n:
            left.take(size, 1)
            room = capacity - size
            partner = left.largest(room)
            low = left.smallest(2)
            certain = not partner or partner == room or len(low) < 2 or sum(low) > room
            if not certain:
                three = left.smallest(3)
                certain = (len(three) < 3 or sum(three) > room) and partner >= left.best_pair(room)
            if not certain:
                left.n[size] = left.n.get(size, 0) + 1
                if left.n[size] == 1:
                    insort(left.order, size)
                break
            if not partner:
                k = 1 + left.n.get(size, 0)
                if k > 1:
                    left.take(size, k - 1)
                closed.append(((size,), k))
                continue
            if partner == size:
                k = 1 + (left.n[size] - 1) // 2
                left.take(size, 2 * k - 1)
            else:
                k = min(1 + left.n.get(size, 0), left.n[partner])
                left.take(partner, k)
                if k > 1:
                    left.take(size, k - 1)
            closed.append(((size, partner), k))
    return closed, left.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Containers as (sizes, number), each text in descending size where the least space is left."""
    open_runs: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, sizes: tuple[int, ...], k: int) -> None:
        if not open_runs[room]:
            insort(rooms, room)
        open_runs[room].append((sizes, k))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                if n >= per:
                    put(capacity - per * size, (size,) * per, n // per)
                    n %= per
                else:
                    put(capacity - n * size, (size,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            sizes, have = open_runs[room].pop()
            if not open_runs[room]:
                rooms.pop(at)
            per = room // size
            if n >= per:
                k = min(have, n // per)
                put(room - per * size, sizes + (size,) * per, k)
                n -= k * per
            else:
                k = 1
                put(room - n * size, sizes + (size,) * n, 1)
                n = 0
            if have > k:
                put(room, sizes, have - k)
    return [run for room in sorted(open_runs) for run in open_runs[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, last rank, first container) of every run; ranks and containers count from 0."""
    closed, rest = reduce_dominated({s: c for s, c in counts.items() if s}, capacity)
    out = [(0, 0, counts[0] - 1, 0)] if counts.get(0) else []
    seen: dict[int, int] = defaultdict(int)
    first = 0
    for sizes, k in closed + best_fit(rest, capacity):
        for size in sizes:
            out.append((size, seen[size], seen[size] + k - 1, first))
            seen[size] += k
        first += k
    return out


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece and size: a text within the capacity is one piece."""
    size = F.col("n_tokens")
    last = F.greatest(F.lit(0), F.ceil(size / capacity).cast("int") - 1)
    cut = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), size - F.col("piece") * capacity).cast("int").alias("size"))


def containers(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, size and container of every text or piece; `sizes` has doc_id and n_tokens, materialised.

    Ranks within a size are given by block of documents, so that a common size is never ranked in one task.
    """
    cut = pieces(sizes, capacity).withColumn("block", F.expr("pmod(xxhash64(doc_id, piece), 64)"))
    blocks = cut.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n"))
    held = blocks.collect()
    counts: dict[int, int] = defaultdict(int)
    offsets = []
    for size, block, n in sorted(map(tuple, held)):
        offsets.append((size, block, counts[size]))
        counts[size] += n
    spark = sizes.sparkSession
    before = spark.createDataFrame(offsets, "size int, block long, before long")
    runs = spark.createDataFrame(plan(counts, capacity), "size int, low long, high long, first long")
    within = F.row_number().over(Window.partitionBy("size", "block").orderBy("doc_id", "piece")) - 1
    ranked = cut.withColumn("within", within).join(F.broadcast(before), ["size", "block"]).withColumn("rank", F.col("within") + F.col("before"))
    met = ranked.join(F.broadcast(runs), "size").where("rank BETWEEN low AND high")
    place = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("first") + F.col("rank") - F.col("low"))
    return met.select("doc_id", "piece", "size", place.alias("container"))


def fill(placed: DataFrame, capacity: int) -> DataFrame:
    """container, n_pieces, fill and share of every container."""
    total = F.sum("size")
    return placed.groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), total.alias("fill"), (total / capacity).alias("share"))
