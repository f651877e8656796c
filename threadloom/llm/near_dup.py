"""Near-duplicate records: an exact set-similarity join by set-relation skipping, and its groups.

A text is the set of its runs of `words` successive words. Two texts belong together if their sets' Jaccard similarity
reaches the threshold. The join is exact; nothing is sampled or capped.

* Sets are sorted by one global order, rare shingles first, and only a prefix of each is indexed and probed: sets that share
  less than `SHARED` shingles there can't be similar. The order is by exact document frequency, counted over all classes and joined back, whatever their
  number; shingles of one class alone can't be shared, so only their number is kept.
* Index lists are skipped in blocks. The entries of a list with the same set size and position form one block, and a block is
  compared with another as a whole: if what is left behind the two positions can't make up the overlap, no entry of either
  is looked at. Lists of more than `HOT` prefix entries are cut into a grid: each cell holds one part as index and one as
  probes, so no task holds more than two parts of a list.
* Answers are derived. Sets that agree in their least hashes form a family; a member is known by how much it adds to and lacks of
  the family's leader. The overlap of a candidate with the leader, worked out once, decides most of the members by the sizes of
  their differences alone, and only the undecided are compared shingle by shingle.

Exact copies are one class from the first step on: the join runs over classes, `pairs` expands them, `groups` doesn't.

Null texts are empty. Texts of fewer than `min_words` words, or of fewer than `words`, belong to nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import cut

HOT, SHARED, CHUNK, PAIRS_AT_ONCE = 50_000, 4, 400_000, 2_000_000
WORD = re.compile("[a-z0-9]+")
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

_WORDS: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, hash) of the distinct shingles, sorted by both; texts with too few words have none."""
    import xxhash

    if len(_WORDS) > 500_000:
        _WORDS.clear()
    flat: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = WORD.findall(text.lower()) if text else []
        if len(found) < max(min_words, words):
            continue
        sizes[k] = len(found)
        for w in found:
            h = _WORDS.get(w)
            if h is None:
                h = _WORDS[w] = xxhash.xxh3_64_intdigest(w)
            flat.append(h)
    h = np.array(flat, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    if len(h) < words:
        return owner[:0], h[:0]
    total = len(h) - words + 1
    run = np.zeros(total, np.uint64)
    for k in range(words):
        run = _mix(run * M1 + h[k : k + total] * M2 + M3)
    whole = owner[:total] == owner[words - 1 :]
    run, owner = run[whole], owner[:total][whole]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.r_[True, (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])] if len(run) else np.zeros(0, bool)
    return owner[new], run[new]


class Similarity:
    """The arithmetic of Jaccard >= p/q on set sizes, with prefixes in which similar sets share at least `shared` shingles.

    If two sets share o, the one that is `shared`-th in the order stands at most n - o + shared deep in either, so prefixes that reach there
    hold that many (all of them, where o is smaller). Longer prefixes cost entries and spare most pairs that meet by chance.
    """

    def __init__(self, threshold: Fraction, shared: int = 1) -> None:
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be in (0, 1]")
        self.p, self.q, self.shared = threshold.numerator, threshold.denominator, shared

    def overlap(self, a, b):
        return -(-self.p * (a + b) // (self.p + self.q))

    def probed(self, n):
        return np.minimum(n, n + (-self.p * n // self.q) + self.shared)

    def indexed(self, n):
        return np.minimum(n, n + (-2 * self.p * n // (self.p + self.q)) + self.shared)


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of rows, each repeated count times, with first, first + 1, ... beside them."""
    row = np.repeat(np.arange(len(count)), count)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _in_parts(count: np.ndarray, most: int) -> Iterator[slice]:
    """Ranges of rows whose counts add up to about `most`."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        yield slice(lo, hi)
        lo = hi


def list_hits(key: np.ndarray, n: np.ndarray, pos: np.ndarray, sig: np.ndarray, role: np.ndarray, sim: Similarity) -> Iterator[tuple[np.ndarray, ...]]:
    """(sig_a, sig_b, n_a, n_b, pos_a, pos_b) of the entries of the same list that pass the positional test, a smaller by (n, sig).

    role: 1 index, 2 probe, 3 both.
    """
    order = np.lexsort((role, pos, n, key))
    key, n, pos, sig, role = (x[order] for x in (key, n, pos, sig, role))
    new = np.r_[True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (pos[1:] != pos[:-1]) | (role[1:] != role[:-1])]
    head = np.flatnonzero(new)
    size = np.diff(np.r_[head, len(key)])
    k, bn, bp, br = key[head], n[head].astype(np.int64), pos[head].astype(np.int64), role[head]
    _, k = np.unique(k, return_inverse=True)
    span = np.int64(bn.max(initial=0) * (sim.q // sim.p + 2) + 2)
    place = k * span + bn
    left = np.flatnonzero((br & 1 > 0) & (bp < sim.indexed(bn)))
    lo = np.searchsorted(place, place[left], "left")
    hi = np.searchsorted(place, k[left] * span + np.minimum(bn[left] * sim.q // sim.p, span - 1), "right")
    for part in _in_parts(hi - lo, PAIRS_AT_ONCE):
        row, b = _spread(lo[part], (hi - lo)[part])
        a = left[part][row]
        ok = (br[b] & 2 > 0) & (sim.shared + np.minimum(bn[a] - bp[a] - 1, bn[b] - bp[b] - 1) >= sim.overlap(bn[a], bn[b]))
        a, b = a[ok], b[ok]
        for some in _in_parts(size[a] * size[b], PAIRS_AT_ONCE):
            x, y = a[some], b[some]
            row, cell = _spread(np.zeros(len(x), np.int64), size[x] * size[y])
            i, j = head[x[row]] + cell // size[y[row]], head[y[row]] + cell % size[y[row]]
            keep = (n[i] < n[j]) | ((n[i] == n[j]) & (sig[i] < sig[j]))
            i, j = i[keep], j[keep]
            yield sig[i], sig[j], n[i], n[j], pos[i], pos[j]


class Join:
    """The similarity join of ``record_id, text``.

    `members` is one row ``record_id, sig`` per record that takes part (sig: its class of equal sets), `sets` one row
    ``sig, n, shingles`` per class that shares a shingle with another (n: all its shingles; shingles: the shared ones, rare first),
    `links` one row per pair of similar classes.
    """

    def __init__(self, records: DataFrame, words: int = 5, threshold: Fraction = Fraction(4, 5), min_words: int = 0, hot: int = HOT, shared: int = SHARED) -> None:
        self.words, self.min_words, self.hot, self.sim = words, min_words, hot, Similarity(threshold, shared)
        self.records = records.select(F.col("record_id").cast("long").alias("record_id"), F.col("text").cast("string").alias("text"))
        self.spark = records.sparkSession
        found = cut(self._found())
        self.members = cut(found.select("record_id", "sig").distinct())
        classes = found.groupBy("sig").agg(F.first("shingles").alias("shingles"))
        entries = classes.select("sig", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
        often = entries.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
        shared = entries.join(often, "shingle").groupBy("sig").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
        self.sets = cut(shared.select("sig", "n", F.transform("s", lambda x: x["shingle"]).alias("shingles")))

    def _found(self) -> DataFrame:
        words, min_words = self.words, self.min_words

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2000):
                    part = batch.slice(lo, 2000)
                    owner, h = shingle_sets(part.column(1).to_pylist(), words, min_words)
                    if not len(h):
                        continue
                    head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                    sig = _mix(np.add.reduceat(_mix(h ^ M3), head)).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(h)].astype(np.int32)), pa.array(h.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[head])), pa.array(sig), lists], ["record_id", "sig", "shingles"])

        return self.records.mapInArrow(run, "record_id long, sig long, shingles array<long>")

    def _postings(self) -> DataFrame:
        """Prefix entries ``shingle, sig, n, pos, role``; the shingles that a set has for itself alone stand before all others."""
        sim = self.sim

        def run(batches):
            for batch in batches:
                lists = batch.column("shingles")
                size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                h = lists.flatten().to_numpy(zero_copy_only=False)
                n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
                start, alone = np.cumsum(size) - size, n - size
                row, at = _spread(start, np.maximum(np.minimum(sim.probed(n), n) - alone, 0))
                pos, h = at - start[row] + alone[row], h[at]
                sig, n = batch.column("sig").to_numpy(zero_copy_only=False)[row], n[row]
                role = np.where(pos < sim.indexed(n), 3, 2)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(sig), pa.array(n, pa.int32()), pa.array(pos, pa.int32()), pa.array(role, pa.int8())], ["shingle", "sig", "n", "pos", "role"])

        return self.sets.mapInArrow(run, "shingle long, sig long, n int, pos int, role byte")

    def _cells(self) -> DataFrame:
        """Postings with ``salt``: long lists are dealt to a grid of cells, an index part by a part of the probes each."""
        lists = self._postings()
        long = cut(lists.groupBy("shingle").agg(F.count("*").alias("m")).where(F.col("m") > self.hot).select("shingle", F.ceil(F.col("m") / self.hot).cast("int").alias("g")))
        names = ("shingle", "salt", "sig", "n", "pos", "role")
        if not long.head(1):
            return lists.withColumn("salt", F.lit(0)).select(*names)
        both = lists.join(long, "shingle", "left").withColumn("part", F.pmod(F.xxhash64("sig"), F.col("g")).cast("int"))
        short = both.where("g is null").withColumn("salt", F.lit(0))
        # cell (index part, probe part) is salt g * index part + probe part; an entry that is both goes to its own cell once
        other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
        far = both.where("g is not null").withColumn("other", other)
        index = far.where("role = 3 and other <> part").withColumn("salt", F.expr("g * part + other")).withColumn("role", F.lit(1).cast("byte"))
        probe = far.where("other <> part").withColumn("salt", F.expr("g * other + part")).withColumn("role", F.lit(2).cast("byte"))
        own = far.where("other = part").withColumn("salt", F.expr("g * part + part"))
        return short.select(*names).unionByName(index.select(*names)).unionByName(probe.select(*names)).unionByName(own.select(*names))

    def candidates(self) -> DataFrame:
        """Pairs of classes ``sig_a, sig_b, n_a, n_b`` that share enough of their prefixes to be similar still."""
        sim = self.sim
        names = ("shingle", "salt", "sig", "n", "pos", "role")

        def hits(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            _, key = np.unique(rows["shingle"].view(np.uint64) + rows["salt"].astype(np.uint64) * M1, return_inverse=True)
            for a, b, n_a, n_b, p_a, p_b in list_hits(key, rows["n"], rows["pos"], rows["sig"], rows["role"], sim):
                if len(a):
                    order = np.lexsort((b, a))
                    a, b, n_a, n_b, p_a, p_b = (x[order] for x in (a, b, n_a, n_b, p_a, p_b))
                    head = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                    columns = (a[head], b[head], n_a[head], n_b[head], np.diff(np.r_[head, len(a)]), np.maximum.reduceat(p_a, head), np.maximum.reduceat(p_b, head))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), *[pa.int32()] * 5), strict=True)], ["sig_a", "sig_b", "n_a", "n_b", "c", "p_a", "p_b"])

        def run(batches):
            held: list[dict] = []
            rows = 0
            for batch in batches:
                held.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names})
                rows += batch.num_rows
                if rows < CHUNK:
                    continue
                whole = {c: np.concatenate([x[c] for x in held]) for c in names}
                last = (whole["shingle"] == whole["shingle"][-1]) & (whole["salt"] == whole["salt"][-1])
                if not last.all():
                    yield from hits({c: x[~last] for c, x in whole.items()})
                held = [{c: x[last] for c, x in whole.items()}]
                rows = int(last.sum())
            if rows:
                yield from hits({c: np.concatenate([x[c] for x in held]) for c in names})

        lists = self._cells().repartition("shingle", "salt").sortWithinPartitions("shingle", "salt")
        found = lists.mapInArrow(run, "sig_a long, sig_b long, n_a int, n_b int, c int, p_a int, p_b int")
        each = found.groupBy("sig_a", "sig_b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("c").alias("c"), F.max("p_a").alias("p_a"), F.max("p_b").alias("p_b"))
        most = F.col("c") + F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) - 1
        least = self._least(F.col("n_a"), F.col("n_b"))
        return each.where((most >= least) & (F.col("c") >= F.least(least, F.lit(sim.shared)))).select("sig_a", "sig_b", "n_a", "n_b")

    def _least(self, a: Column, b: Column) -> Column:
        return F.ceil(F.lit(self.sim.p) * (a + b) / F.lit(self.sim.p + self.sim.q) - F.lit(1e-9))

    def families(self) -> DataFrame:
        """Members ``sig, leader, adds, lacks`` (numbers of shingles) of families, not their leaders: classes that agree in their two
        least hashes and differ in at most a quarter of their shingles."""
        lead = F.slice(F.array_sort(F.transform("shingles", lambda x: F.xxhash64(x))), 1, 2)
        keyed = self.sets.where(F.size("shingles") > 1).select("sig", F.xxhash64(lead).alias("family"))
        leaders = keyed.groupBy("family").agg(F.min("sig").alias("leader"), F.count("*").alias("size")).where("size > 1")
        member = keyed.join(leaders, "family").where("sig <> leader").select("sig", "leader")
        own, theirs = self.sets.select("sig", "n", F.col("shingles").alias("own")), self.sets.select(F.col("sig").alias("leader"), F.col("n").alias("n_leader"), F.col("shingles").alias("theirs"))
        both = member.join(own, "sig").join(theirs, "leader").withColumn("common", F.size(F.array_intersect("own", "theirs")))
        both = both.select("sig", "leader", (F.col("n") - F.col("common")).alias("adds"), (F.col("n_leader") - F.col("common")).alias("lacks"), "n")
        return both.where((F.col("adds") + F.col("lacks")) * 4 <= F.col("n")).select("sig", "leader", "adds", "lacks")

    def links(self) -> DataFrame:
        """Pairs of similar classes ``sig_a, sig_b, n_a, n_b``, each once."""
        least = self._least(F.col("n_a"), F.col("n_b"))
        family = self.families().withColumnRenamed("sig", "sig_a")
        pairs = cut(self.candidates().join(family, "sig_a", "left").withColumn("leader", F.coalesce("leader", "sig_a")))
        side = lambda sig, name: self.sets.select(F.col("sig").alias(sig), F.col("shingles").alias(name))
        led = pairs.select("leader", "sig_b").distinct().join(side("leader", "x"), "leader").join(side("sig_b", "y"), "sig_b")
        led = led.select("leader", "sig_b", F.size(F.array_intersect("x", "y")).alias("shared"))
        judged = pairs.join(led, ["leader", "sig_b"]).withColumn("sure", F.when(F.col("shared") - F.coalesce("lacks", F.lit(0)) >= least, True).when(F.col("shared") + F.coalesce("adds", F.lit(0)) < least, False))
        judged = cut(judged.select("sig_a", "sig_b", "n_a", "n_b", "sure"))
        open_ = judged.where("sure is null").join(side("sig_a", "x"), "sig_a").join(side("sig_b", "y"), "sig_b").where(F.size(F.array_intersect("x", "y")) >= least)
        names = ("sig_a", "sig_b", "n_a", "n_b")
        return judged.where("sure").select(*names).unionByName(open_.select(*names))

    def pairs(self) -> DataFrame:
        """``record_id_a, record_id_b`` (a < b) of all similar records, copies expanded."""
        a, b = (self.members.select(F.col("sig").alias(f"sig_{x}"), F.col("record_id").alias(f"id_{x}")) for x in "ab")
        across = self.links().join(a, "sig_a").join(b, "sig_b").select(F.least("id_a", "id_b").alias("record_id_a"), F.greatest("id_a", "id_b").alias("record_id_b"))
        copies = self.members.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig")
        same = self.members.join(copies, "sig")
        within = same.select("sig", F.col("record_id").alias("record_id_a")).join(same.select("sig", F.col("record_id").alias("record_id_b")), "sig").where("record_id_a < record_id_b")
        return across.unionByName(within.select("record_id_a", "record_id_b")).where("record_id_a <> record_id_b").distinct()

    def groups(self) -> DataFrame:
        """One row per record that takes part: record_id, group_id (the least record_id that is linked to it, over any number of
        steps), copies (records of the same set, itself included) and links (classes similar to its own)."""
        links = cut(self.links().select("sig_a", "sig_b"))
        ends = links.select(F.col("sig_a").alias("sig")).unionAll(links.select(F.col("sig_b").alias("sig"))).groupBy("sig").agg(F.count("*").alias("links"))
        part = components(links.withColumnsRenamed({"sig_a": "a", "sig_b": "b"}))
        classes = self.members.groupBy("sig").agg(F.min("record_id").alias("least"), F.count("*").alias("copies"))
        classes = classes.join(part.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
        named = classes.groupBy("component").agg(F.min("least").alias("group_id"))
        classes = classes.join(named, "component").join(ends, "sig", "left")
        return self.members.join(classes.select("sig", "group_id", "copies", F.coalesce("links", F.lit(0)).alias("links")), "sig").select("record_id", "group_id", "copies", "links")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``a, b``: ``node, component`` (its least node), for nodes of at least one edge to another.

    Each round hangs every node's neighbours under the least of them, in turns over larger neighbours and over all smaller
    ones, until nothing moves; the number of rounds grows with the logarithm of a component's size. Each round is written.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(small.select("u", F.col("m").alias("v"))).distinct()
        then = cut(small)
        changed = now.exceptAll(then).limit(1).count() + then.exceptAll(now).limit(1).count()
        now = then
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())


def curated_texts(curated: DataFrame) -> DataFrame:
    """``record_id, text``: title, a blank and body of each curated record; nulls are empty."""
    return curated.select("record_id", F.concat(F.coalesce("input_vector.title", F.lit("")), F.lit(" "), F.coalesce("input_vector.body", F.lit(""))).alias("text"))
