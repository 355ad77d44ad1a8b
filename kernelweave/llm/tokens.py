"""Encoding with a public byte-level tokenizer: a perfect-hash lookup, then merging by a heap.

Tier 1: a text is cut into pre-tokens by the vocabulary's pattern, and a minimal perfect hash over the
vocabulary finds whole pre-tokens in it. Tier 2: what is missed is merged by rank, with a heap of
candidate pairs over a doubly linked list of its bytes, so a very long run costs n log n. Both tiers
run in Arrow batches; their answers are remembered per worker for frequent pre-tokens.

The tables are built once from the vocabulary file and shipped to the workers; their size is bounded
by the vocabulary. Defined results: empty and null texts have no tokens; strings of special
tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_VOCABULARY = 1_000_000
MAX_SHIFTS = 100_000
SEEDS = 32
_WORD = (1 << 64) - 1
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _slot(h: int, d: int, n: int) -> int:
    """Slot of a digest under displacement d; mixed, so that every slot is reached as d grows."""
    z = ((h >> 64) ^ (d * 0x9E3779B97F4A7C15)) & _WORD
    z = ((z ^ (z >> 31)) * 0xD6E8FEB86659FD93) & _WORD
    return (z ^ (z >> 29)) % n


@dataclass
class PerfectHash:
    """Minimal perfect hash over byte strings by hash and displace.

    A key's digest gives its bucket; each bucket's displacement is the first that puts all its keys into
    free slots. Buckets of a single key come last and hold the address of a free slot instead, as -1 - slot.
    With as many slots as keys, every slot holds one key's bytes and id. A bucket without a displacement
    within the bound makes the build start again with the next seed.
    """

    shifts: list[int]
    keys: list[bytes]
    ids: list[int]
    seed: int = 0

    @classmethod
    def build(cls, entries: dict[bytes, int]) -> PerfectHash:
        if len(entries) > MAX_VOCABULARY:
            raise ValueError(f"a vocabulary of {len(entries)} entries is beyond the bound of {MAX_VOCABULARY}")
        for seed in range(SEEDS):
            if built := cls._build(entries, seed):
                return built
        raise ValueError(f"no perfect hash over {len(entries)} entries with {SEEDS} seeds")

    @classmethod
    def _build(cls, entries: dict[bytes, int], seed: int) -> PerfectHash | None:
        n = len(entries)
        m = max(1, -(-n // 3))
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(m)]
        for key in entries:
            h = xxhash.xxh3_128_intdigest(key, seed)
            buckets[h % m].append((h, key))
        shifts, keys, ids = [0] * m, [b""] * n, [-1] * n
        free = bytearray(b"\x01") * n
        at = 0
        for b in sorted(range(m), key=lambda x: -len(buckets[x])):
            own = buckets[b]
            if not own:
                break
            if len(own) == 1:
                at = free.index(1, at)
                shifts[b], slots = -1 - at, [at]
            else:
                for d in range(MAX_SHIFTS):
                    slots = [_slot(h, d, n) for h, _ in own]
                    if all(free[s] for s in slots) and len(set(slots)) == len(own):
                        break
                else:
                    return None
                shifts[b] = d
            for s, (_, key) in zip(slots, own, strict=True):
                free[s], keys[s], ids[s] = 0, key, entries[key]
        return cls(shifts, keys, ids, seed)

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        n = len(self.keys)
        if not n:
            return -1
        h = xxhash.xxh3_128_intdigest(key, self.seed)
        d = self.shifts[h % len(self.shifts)]
        s = -1 - d if d < 0 else _slot(h, d, n)
        return self.ids[s] if self.keys[s] == key else -1


class Encoder:
    """Ids of a text by one vocabulary."""

    def __init__(self, lookup: PerfectHash, pattern: str):
        self.lookup, self.cut, self.known = lookup, regex.compile(pattern), {}

    def merge(self, piece: bytes) -> list[int]:
        """Merge adjacent parts by ascending rank, the leftmost first among equals."""
        get, n = self.lookup.get, len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), [*range(1, n), -1]
        rank = [get(piece[k : k + 2]) if k + 1 < n else -1 for k in range(n)]
        heap = [(r, k) for k, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            if rank[k] != r:
                continue
            gone = after[k]
            end[k], after[k], rank[gone] = end[gone], after[gone], -2
            if after[k] >= 0:
                before[after[k]] = k
            for x in (k, before[k]):
                if x < 0:
                    continue
                rank[x] = get(piece[x : end[after[x]]]) if after[x] >= 0 else -1
                if rank[x] >= 0:
                    heapq.heappush(heap, (rank[x], x))
        out, k = [], 0 if n else -1
        while k >= 0:
            part = get(piece[k : end[k]])
            if part < 0:
                raise ValueError(f"the vocabulary has no token for {piece[k : end[k]]!r}")
            out.append(part)
            k = after[k]
        return out

    def piece(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "replace")
        whole = self.lookup.get(raw)
        ids = [whole] if whole >= 0 else self.merge(raw)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, piece = self.known, self.piece
        return list(chain.from_iterable([known[x] if x in known else piece(x) for x in self.cut.findall(text)]))


def load_vocabulary(path: str | None = None) -> PerfectHash:
    """Perfect hash of a file of ranks (one base64 token and its rank per line)."""
    with open(path or _public("byte_bpe_50k.tiktoken"), "rb") as lines:
        return PerfectHash.build({base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())})


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None, only_count: bool = False) -> DataFrame:
    """key and ids (array of int), or with `only_count` n_tokens, one row per input row."""
    shipped = df.sparkSession.sparkContext.broadcast((load_vocabulary(path), pattern or _public_pattern()))
    name = "n_tokens" if only_count else "ids"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shipped.value)
        for batch in batches:
            if only_count:
                out = pa.array([len(encoder.encode(t)) for t in batch.column(1).to_pylist()], pa.int32())
            else:
                rows = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                ends = np.zeros(len(rows) + 1, np.int32)
                np.cumsum([len(r) for r in rows], out=ends[1:])
                out = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=[key, name])

    source = df.select(key, F.col(text).alias("__text"))
    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(scan, f"`{key}` {kind}, {name} {'int' if only_count else 'array<int>'}")
