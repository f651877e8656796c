"""Items that appear together: a blocked Gram matrix over binary sparse baskets, set against expected marginals.

Every basket is a row of a binary matrix X. Each task sums X'X over its record blocks and sends only the sums, so what is shuffled
follows the distinct pairs that a task meets, not the pairs per basket; n(a,b) is then divided by n(a) n(b) / N, what chance would give.

There is one plan for any number of items. A task numbers items as it meets them. Items that stand in at least 1 / `DENSE` of
the records of a block are columns of dense item blocks, whose transpose-products are taken block pair by block pair; products with the
others, whose columns are nearly empty, are taken from their coordinates. Both are the same sums, exact; what a task
holds is bounded by `HELD`, beyond which it sends what it has.

Pairs asked for by their share of the records (`min_share` >= `PRUNED`) can only hold items of that share. There are at most (items
per basket) / min_share of those whatever the number of records; tasks get that list and skip all other items.

Null and blank items drop out, repeated items of a basket count once, empty baskets count in N only. An empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

RECORDS, BLOCK, DENSE, HELD, PRUNED = 4096, 256, 64, 1_000_000, 1e-4
PAIRS = "item_a string, item_b string, n bigint"


def clean_item(x: Column) -> Column:
    """Trimmed of white space, lower-cased, blanks and hyphens as underscores; null if nothing is left."""
    t = F.translate(F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), " -", "__")
    return F.when(t != "", t)


def artifact_baskets(artifact: DataFrame) -> DataFrame:
    """One basket per artifact_id, ``items array<string>``, from its row with the greatest extracted_at.

    Rows that tie on extracted_at are ordered by type, then tags; a null extracted_at comes before all others.
    """
    last = artifact.groupBy("artifact_id").agg(F.max(F.struct("extracted_at", "type", "tags")).alias("r"))
    kind = F.array(F.concat(F.lit("type:"), clean_item(F.col("r.type"))))
    tags = F.transform(F.coalesce("r.tags", F.array().cast("array<string>")), lambda t: F.concat(F.lit("tag:"), clean_item(t)))
    return last.select("artifact_id", F.array_distinct(F.array_compact(F.concat(kind, tags))).alias("items"))


class Gram:
    """Sums X'X of the record blocks that `take` gets; `entries` gives and forgets the sums of pairs of different items."""

    def __init__(self, held: int = HELD) -> None:
        self.held = held
        self.names: list[str] = []
        self.number: dict[str, int] = {}
        self.blocks = 0
        self._forget()

    def _forget(self) -> None:
        self.place = np.full(len(self.names), -1, np.int64)  # column of an item in the dense part
        self.column = np.zeros(0, np.int64)
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def numbers(self, items: list[str]) -> np.ndarray:
        out = np.empty(len(items), np.int64)
        for k, x in enumerate(items):
            n = self.number.get(x)
            if n is None:
                n = self.number[x] = len(self.names)
                self.names.append(x)
            out[k] = n
        return out

    @property
    def full(self) -> bool:
        return self.size > self.held or len(self.names) > self.held

    def take(self, row: np.ndarray, item: np.ndarray) -> Iterator[pa.RecordBatch]:
        """row ascending, each (row, item) once; gives sums only where the dense columns are chosen anew or too many are held."""
        for lo in range(0, int(row[-1]) + 1 if len(row) else 0, RECORDS):
            a, b = np.searchsorted(row, (lo, lo + RECORDS))
            r, i = row[a:b] - lo, item[a:b]
            self.blocks += 1
            if self.blocks & (self.blocks - 1) == 0:  # blocks 1, 2, 4, 8, ...: look again at which items are frequent
                yield from self.entries()
                found, n = np.unique(i, return_counts=True)
                self.column = found[n * DENSE >= max(DENSE, int(r[-1]) + 1 if len(r) else 1)]
            if len(self.place) < len(self.names) or not len(self.dense):
                self.place = np.full(len(self.names), -1, np.int64)
                self.place[self.column] = np.arange(len(self.column))
            self._products(r, self.place[i])
            yield from self._coordinates(r, i, self.place[i])

    def _products(self, row: np.ndarray, place: np.ndarray) -> None:
        parts = {}
        for k in range(-(-len(self.column) // BLOCK)):
            at = place // BLOCK == k
            held, where = np.unique(row[at], return_inverse=True)
            x = np.zeros((len(held), BLOCK), np.float32)
            x[where, place[at] % BLOCK] = 1
            parts[k] = held, x
        for k, (rows_k, x) in parts.items():
            for m, (rows_m, y) in parts.items():
                if m < k:
                    continue
                _, p, q = np.intersect1d(rows_k, rows_m, assume_unique=True, return_indices=True)
                if len(p):
                    part = (x[p].T @ y[q]).astype(np.int64)  # at most RECORDS, exact in float32
                    known = self.dense.get((k, m))
                    self.dense[k, m] = part if known is None else known + part

    def _coordinates(self, row: np.ndarray, item: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Products with an item outside the dense part: each such item of a row with what stands behind it."""
        order = np.lexsort((place >= 0, row))
        row, item, place = row[order], item[order], place[order]
        end = np.searchsorted(row, row, "right")
        cold = np.flatnonzero(place < 0)
        more = end[cold] - cold - 1
        total, lo = np.cumsum(more), 0
        while lo < len(cold):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + self.held, "right")))
            n = more[lo:hi]
            first = np.repeat(cold[lo:hi], n)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            a, b = item[first], item[second]
            pair, count = np.unique(np.minimum(a, b) << np.int64(32) | np.maximum(a, b), return_counts=True)
            self.sparse.append((pair, count))
            self.size += len(pair)
            lo = hi
            if self.size > self.held:
                self._merge()
                if self.size > self.held // 2:
                    yield from self.entries()

    def _merge(self) -> None:
        pair = np.concatenate([p for p, _ in self.sparse]) if self.sparse else np.zeros(0, np.int64)
        count = np.concatenate([c for _, c in self.sparse]) if self.sparse else np.zeros(0, np.int64)
        each, at = np.unique(pair, return_inverse=True)
        self.sparse = [(each, np.bincount(at, count, len(each)).astype(np.int64))]
        self.size = len(each)

    def entries(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        names = pa.array(self.names, pa.string())
        ((pair, count),) = self.sparse
        found = [(pair >> np.int64(32), pair & np.int64(0xFFFFFFFF), count)]
        for (k, m), g in self.dense.items():
            i, j = np.nonzero(np.triu(g, 1) if k == m else g)
            found.append((self.column[i + k * BLOCK], self.column[j + m * BLOCK], g[i, j]))
        for i, j, n in found:
            for lo in range(0, len(n), 100_000):
                a, b = (names.take(pa.array(x[lo : lo + 100_000])) for x in (i, j))
                first = pc.less(a, b)
                yield pa.RecordBatch.from_arrays([pc.if_else(first, a, b), pc.if_else(first, b, a), pa.array(n[lo : lo + 100_000], pa.int64())], ["item_a", "item_b", "n"])
        column = self.column
        self._forget()
        self.column = column

    def restart(self) -> None:
        """Forget the names too, between batches."""
        self.names, self.number, self.blocks = [], {}, 0
        self._forget()


def pair_counts(baskets: DataFrame, items: list[str] | None = None, held: int = HELD) -> DataFrame:
    """``item_a, item_b, n`` with item_a < item_b in byte order, over baskets with a column ``items``; of `items` alone if given."""
    known = None if items is None else pa.array(items, pa.string())

    def run(batches):
        gram = Gram(held)
        for batch in batches:
            lists = batch.column(0)
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            row, flat = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(lists)
            if known is not None:
                wanted = pc.is_in(flat, value_set=known)
                row, flat = row[wanted.to_numpy(zero_copy_only=False)], flat.filter(wanted)
            coded = flat.dictionary_encode()
            there = coded.indices.is_valid().to_numpy(zero_copy_only=False)
            row, at = row[there], coded.indices.drop_null().to_numpy(zero_copy_only=False)
            if not len(row):
                continue
            item = gram.numbers(coded.dictionary.to_pylist())[at]
            order = np.lexsort((item, row))
            row, item = row[order], item[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])]
            yield from gram.take(row[new], item[new])
            if gram.full:
                yield from gram.entries()
                gram.restart()
        yield from gram.entries()

    return baskets.select("items").mapInArrow(run, PAIRS).groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def cooccurrence(baskets: DataFrame, min_count: int = 10, min_share: float = 0.001, min_lift: float = 0.0) -> DataFrame:
    """Pairs with n(a,b) >= min_count, n(a,b) >= min_share * N and lift >= min_lift.

    Columns: item_a, item_b, n_a, n_b, n_ab, n_total, expected, lift.
    """
    baskets = cut(baskets.select("items"))
    total = baskets.count()
    least = max(min_count, math.ceil(round(min_share * total, 6)), 1)
    single = baskets.select(F.explode(F.array_distinct("items")).alias("item")).where("item is not null").groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # min_share bounds the number of names by (items per basket) / min_share
    names = [r.item for r in single.select("item").collect()] if min_share >= PRUNED else None
    pairs = pair_counts(baskets, names).where(F.col("n") >= least)
    a, b = (single.select(F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    n, expected = F.lit(total).cast("long"), F.col("n_a").cast("double") * F.col("n_b") / total if total else F.lit(0.0)
    found = pairs.withColumnRenamed("n", "n_ab").join(a, "item_a").join(b, "item_b")
    return found.select("item_a", "item_b", "n_a", "n_b", "n_ab", n.alias("n_total"), expected.alias("expected"), (F.col("n_ab").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift")).where(
        F.col("n_ab").cast("decimal(38,6)") * total >= F.lit(min_lift).cast("decimal(12,6)") * F.col("n_a") * F.col("n_b")
    )
