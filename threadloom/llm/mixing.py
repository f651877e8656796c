"""Mixing sources to target weights: Pfair scheduling of source blocks.

The mix is T tokens long, T being the most for which every source can give its share within its cap of repeats. A listed source
without tokens (no documents, or none with text) can't give any share: it is left out and the shares of the others are scaled
to sum 1. A source with few tokens isn't left out: shares are kept exactly and caps are never passed, so the scarcest source
(least tokens * cap / share) sets the length of the mix, and what the others have beyond their share of it stays unused.

The mix is cut into blocks of equal size, and the schedule gives each block to a source. Block k of a source with weight w is
released at block time floor(k / w) and due at ceil((k + 1) / w); running the released block with the earliest deadline keeps each
source less than one block from its share at every moment. All else follows from the blocks that a source was given: a source is
a queue of passes over its documents in a fixed order, its blocks are filled from the queue, and a use of a document belongs to the
block that holds its middle. So at every moment a source is off its share by less than one block and half a document. The
schedule's length is a parameter, so the driver's part doesn't grow with the data; at 100 TB a block of the default is 1/2,000 of
the mix, and a finer interleave wants a longer schedule (a million blocks are still a small table).

Where documents stand in their source's order comes from two prefix sums, over hash ranges and inside each range: no source,
however large, is sorted in one task.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut

BLOCKS, RANGES = 2_000, 4_096


def clean_source(x: Column) -> Column:
    """A source's name: trimmed, lower-cased, blanks and hyphens as underscores; null if blank."""
    t = F.translate(F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), " -", "__")
    return F.when(t != "", t)


def pfair(weights: dict[str, Fraction], blocks: int) -> list[str]:
    """The source of each block time 0..blocks-1 by earliest deadline first among released blocks; ties by name.

    Weights add up to 1. Every source's count of blocks stays less than one from weight * time.
    """
    release = lambda w, k: k * w.denominator // w.numerator
    deadline = lambda w, k: -(-(k + 1) * w.denominator // w.numerator)
    waiting = [(0, s) for s in sorted(weights) if weights[s] > 0]
    ready: list[tuple[int, str]] = []
    done = dict.fromkeys(weights, 0)
    out: list[str] = []
    heapq.heapify(waiting)
    for t in range(blocks):
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (deadline(weights[s], done[s]), s))
        if not ready:
            continue
        s = heapq.heappop(ready)[1]
        out.append(s)
        done[s] += 1
        heapq.heappush(waiting, (max(t + 1, release(weights[s], done[s])), s))
    return out


def targets(mix_target: DataFrame) -> dict[str, tuple[Fraction, int]]:
    """Share and cap by source of the fixed small table; shares are scaled to sum 1, rows without share or repeats drop out."""
    rows = mix_target.select(clean_source(F.col("source")).alias("s"), "target_share", "max_repeats").where("s is not null and target_share > 0 and max_repeats > 0").groupBy("s").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("cap")).collect()
    exact = {r.s: (Fraction(str(round(r.w, 9))), int(r.cap)) for r in rows}
    total = sum((w for w, _ in exact.values()), Fraction(0))
    return {s: (w / total, cap) for s, (w, cap) in exact.items()}


class Mix:
    """A mix of documents ``doc_id, source, n_tokens`` (one row each) to a table of targets."""

    def __init__(self, sizes: DataFrame, mix_target: DataFrame, blocks: int = BLOCKS) -> None:
        self.spark, self.want = sizes.sparkSession, targets(mix_target)
        wanted = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), clean_source(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        wanted = wanted.where(F.col("source").isin(*self.want) if self.want else F.lit(False)).distinct()
        place = F.xxhash64("doc_id", F.lit(17))
        self.docs = cut(wanted.withColumn("at", place).withColumn("part", F.pmod(F.shiftright("at", 40), F.lit(RANGES)).cast("int")))
        self.sums = self.docs.groupBy("source", "part").agg(F.sum("n_tokens").alias("tokens"))
        self.has = {r.source: int(r.t) for r in self.sums.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
        there = {s: w for s, (w, _) in self.want.items() if self.has.get(s)}
        self.share = {s: w / sum(there.values()) for s, w in there.items()}
        self.total = min((self.has[s] * self.want[s][1] / w for s, w in self.share.items()), default=Fraction(0))
        self.blocks = min(blocks, int(self.total))
        self.size = int(self.total / self.blocks) if self.blocks else 1
        self.slots: list[tuple[str, int, int]] = []
        self.granted = dict.fromkeys(self.share, 0)
        for time, s in enumerate(pfair(self.share, self.blocks)):
            self.slots.append((s, self.granted[s], time))
            self.granted[s] += 1

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def placed(self) -> DataFrame:
        """Documents with ``before``: the tokens of their source that stand before them in a pass."""
        over = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        start = self.sums.select("source", "part", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("start"))
        inside = Window.partitionBy("source", "part").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        inner = self.docs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        return inner.join(start, ["source", "part"]).select("doc_id", "source", "n_tokens", (F.col("start") + F.col("inner")).alias("before"))

    def _used(self) -> DataFrame:
        """Placed documents with ``pass_tokens`` (of their source) and ``times_used``: the uses whose middle lies in a granted block.

        Use u of a document has its middle at u * pass_tokens + before + n_tokens / 2.
        """
        rows = [(s, self.has[s], n * self.size, self.want[s][1]) for s, n in self.granted.items()]
        plan = F.broadcast(self._table(rows, "source string, pass_tokens long, granted_tokens long, cap long"))  # a row for each listed source
        room = F.expr("2 * granted_tokens - 2 * before - n_tokens")
        times = F.when(room > 0, F.expr("(2 * granted_tokens - 2 * before - n_tokens + 2 * pass_tokens - 1) div (2 * pass_tokens)")).otherwise(0)
        return self.placed().join(plan, "source").withColumn("times_used", F.least(times, "cap").cast("int")).where("times_used > 0")

    def chosen(self) -> DataFrame:
        """doc_id, source, n_tokens, times_used: every document with a use in a block that the schedule gave to its source.

        No document is used more than max_repeats times. One without tokens is used where it stands in its source's order.
        """
        return self._used().select("doc_id", "source", "n_tokens", "times_used")

    def shares(self) -> DataFrame:
        """source, target_share, max_repeats, available_tokens, used_tokens, documents, uses, actual_share, for each listed source.

        target_share is the share among all listed sources; one without tokens reaches 0.
        """
        used = self.chosen().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("used_tokens"), F.count("*").alias("documents"), F.sum("times_used").alias("uses"))
        rows = [(s, float(w), cap, self.has.get(s, 0)) for s, (w, cap) in self.want.items()]
        each = self._table(rows, "source string, target_share double, max_repeats int, available_tokens long").join(used, "source", "left")
        each = each.select("source", "target_share", "max_repeats", "available_tokens", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("used_tokens", "documents", "uses")])
        return each.withColumn("actual_share", F.coalesce(F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy())), F.lit(0.0)))

    def ordered(self) -> DataFrame:
        """Every use of every chosen document in the order of the mix: doc_id, source, n_tokens, use_no, block_time, in_block.

        Sorting by (block_time, in_block, doc_id) gives the interleaved mix; in_block is where the use begins, before the block's
        own start (negative) if it began in the source's block before.
        """
        use = self._used().withColumn("use_no", F.explode(F.sequence(F.lit(0), F.col("times_used") - 1)))
        at = use.withColumn("offset", F.col("use_no") * F.col("pass_tokens") + F.col("before")).withColumn("block_no", F.expr(f"(2 * offset + n_tokens) div {2 * self.size}"))
        slots = F.broadcast(self._table(self.slots, "source string, block_no long, block_time int"))  # one row per block, a parameter
        at = at.join(slots, ["source", "block_no"])
        return at.select("doc_id", "source", "n_tokens", "use_no", "block_time", (F.col("offset") - F.col("block_no") * self.size).alias("in_block"))
