"""Filling containers of fixed capacity: sum-of-squares packing.

An item goes where the sum of squares of the numbers of open bins per residual gap becomes smallest. Only the counts per gap
are held against each other, so one placement costs one pass over the gaps, whatever the number of bins.

Documents are dealt by hash into groups of about `GROUP` documents and each group is packed by one task from ids and sizes
alone. A group leaves a handful of partly filled containers; with that many documents to a group they are lost in the total
(figures in the README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

GROUP = 50_000
ASSIGNED = "container_kind string, capacity_tokens int, doc_id long, piece_no int, token_start long, n_tokens long, container_id long"


class SumOfSquares:
    """Online packing into bins of `capacity`; `place` gives the bin of an item no larger than it."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed and never counted
        self.open: dict[int, list[int]] = {}
        self.bins = 0

    def place(self, size: int) -> int:
        """Ties: the smallest gap that is left, then the bin opened into that gap last; an existing bin before a new one."""
        n, cap = self.count, self.capacity
        best, gap = 2 * int(n[cap - size]) + 1 if size < cap else 0, cap
        fits = n[size:cap]
        where = np.flatnonzero(fits)
        if size and len(where):
            change = 2 * (n[where] - fits[where]) + 2
            if where[0] == 0:
                change[0] = 1 - 2 * fits[0]
            k = int(change.argmin())
            if change[k] <= best:
                best, gap = int(change[k]), int(where[k]) + size
        elif not size and self.bins:
            return self.bins - 1
        if gap == cap:
            where_to, self.bins = self.bins, self.bins + 1
        else:
            where_to = self.open[gap].pop()
            n[gap] -= 1
        if left := gap - size:
            n[left] += 1
            self.open.setdefault(left, []).append(where_to)
        return where_to


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each size, all within the capacity; larger sizes are placed first, as they leave fewer gaps to choose from."""
    packer, out = SumOfSquares(capacity), np.empty(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        out[k] = packer.place(int(sizes[k]))
    return out


def pack(sizes: DataFrame, containers: DataFrame, group: int = GROUP) -> DataFrame:
    """Every document's containers: container_kind, capacity_tokens, doc_id, piece_no, token_start, n_tokens, container_id.

    sizes: ``doc_id, n_tokens``, one row per document (repeated rows count once); containers: the fixed small table
    ``container_kind, capacity_tokens``. A document within the capacity is one piece, never split; a larger one is cut into
    full pieces and a rest. A document of no tokens takes a place in the container opened last. Null sizes count as 0; null
    or non-positive capacities hold nothing and give no rows.
    """
    sizes = cut(sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).distinct())
    groups = max(1, -(-sizes.count() // group))
    kinds = containers.where("capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("int")).distinct().collect()  # the fixed small table
    each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity_tokens")) for k, c in kinds]) if kinds else F.array().cast("array<struct<container_kind:string,capacity_tokens:int>>")
    dealt = sizes.select("doc_id", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int").alias("part"), F.inline(each))

    def one(table: pa.Table) -> pa.Table:
        kind, capacity, part = (table.column(c)[0].as_py() for c in ("container_kind", "capacity_tokens", "part"))
        doc, size = (table.column(c).to_numpy() for c in ("doc_id", "n_tokens"))
        order = np.argsort(doc)
        doc, size = doc[order], size[order]
        full = size // capacity
        rest = size - full * capacity
        pieces = full + ((rest > 0) | (size == 0))
        owner = np.repeat(np.arange(len(doc)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        n = np.where(piece < full[owner], capacity, rest[owner])
        base = np.int64(part) << np.int64(32)
        return pa.table([pa.array([kind] * len(owner), pa.string()), pa.array(np.full(len(owner), capacity), pa.int32()), pa.array(doc[owner]), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(n, pa.int64()), pa.array(pack_sizes(n, capacity) + base)], [x.split()[0] for x in ASSIGNED.split(", ")])

    return dealt.groupBy("container_kind", "part").applyInArrow(one, ASSIGNED)


def fill(assigned: DataFrame) -> DataFrame:
    """The fill of each container: container_kind, container_id, capacity_tokens, n_pieces, used_tokens, empty_tokens, fill."""
    used = assigned.groupBy("container_kind", "container_id").agg(F.first("capacity_tokens").alias("capacity_tokens"), F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("used_tokens"))
    return used.withColumn("empty_tokens", F.col("capacity_tokens") - F.col("used_tokens")).withColumn("fill", F.col("used_tokens") / F.col("capacity_tokens"))


def summary(assigned: DataFrame) -> DataFrame:
    """Per kind: containers used, the least possible number, tokens, and the mean fill."""
    return fill(assigned).groupBy("container_kind").agg(F.count("*").alias("containers"), F.ceil(F.sum("used_tokens") / F.first("capacity_tokens")).alias("least_containers"), F.sum("used_tokens").alias("tokens"), (F.sum("used_tokens") / F.sum("capacity_tokens")).alias("fill"))
