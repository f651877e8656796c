"""Agreement on metadata values by fuzzy matching.

Values that are alike are one phrase with a number: similarities are worked out once per distinct pair of different phrases that meet in
a group, and equal phrases need none. Soft scores come from the best similarity of each phrase, times its number. Hard counts
are those of greedy one-to-one matching, best pairs first, ties in order of the values' places; pairs below the threshold can't
change them. A phrase whose only near phrase has no other near one takes part in min(n, m) matches, whatever the places: these are
counted from the numbers alone. Only phrases with several near ones are matched by place, per group, in one pass over their places.
"""

from __future__ import annotations

import difflib
import heapq
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators.align import ISSUE, ORDER
from threadloom.operators.type_metrics import TARGET
from threadloom.session import cut

METHODS = ("max_all", "token_f1", "sequence_ratio", "token_jaccard", "char_ngram_jaccard", "token_containment")
GROUP = (*ISSUE, "type", "field")


def field_values(aligned: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """One row per metadata value: the group, the side ``h``, its place ``pos`` in the group and side, the value and its phrase.

    Names are trimmed, blank values drop out, the literal ``unknown`` only if asked.
    """
    e = aligned.select(*ISSUE, "type", "h", *ORDER, F.explode(F.map_entries("metadata")).alias("e"))
    v = e.select(*ISSUE, "type", X.strip("e.key").alias("field"), "h", *ORDER, X.strip("e.value").alias("value")).where("value is not null and value <> '' and field <> ''")
    if drop_unknown:
        v = v.where("value <> 'unknown'")
    return v.withColumn("phrase", X.phrase("value"))


def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two phrases; its direction matters. 1 if both are empty, 0 if one is."""
    one = lambda x, y: 1.0 if not x and not y else 0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio()
    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def similarities(pairs: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """``a, b`` (human and model phrase, different ones) with ``f_METHOD`` and ``b_METHOD``, the similarities of (a, b) and of (b, a)."""
    if unknown := set(methods) - set(METHODS):
        raise ValueError(f"unknown similarity {min(unknown)!r}")
    same, ratio = X.similarities("a", "b"), F.pandas_udf(sequence_ratio, "double")
    out = pairs.select("a", "b")
    if {"sequence_ratio", "max_all"} & set(methods):
        out = out.select("a", "b", ratio("a", "b").alias("_f"), ratio("b", "a").alias("_b"))
    columns = []
    for m in methods:
        for way in "fb":
            value = same[m] if m in same else F.col("_" + way) if m == "sequence_ratio" else F.greatest("_" + way, *same.values())
            columns.append(value.alias(f"{way}_{m}"))
    return out.select("a", "b", *columns)


def phrase_similarity(pairs: DataFrame, method: str = "max_all") -> DataFrame:
    """``a, b`` (human and model phrase) with ``forward`` and ``backward``, the similarities of (a, b) and of (b, a)."""
    return similarities(pairs, (method,)).select("a", "b", F.col(f"f_{method}").alias("forward"), F.col(f"b_{method}").alias("backward"))


def match(edges: list[tuple[float, str, str]], values: list[tuple[int, str, str]]) -> int:
    """Number of pairs that greedy matching takes, from near phrases (-similarity, human, model) and values (side, phrase, place).

    Of each similarity, greatest first, humans come in order of their places, and each takes the first model that is left.
    """
    left: dict[tuple[int, str], list[str]] = {}
    for side, phrase, place in values:
        left.setdefault((side, phrase), []).append(place)
    for places in left.values():
        places.sort(reverse=True)
    taken = 0
    for _, level in itertools.groupby(sorted(edges), key=lambda e: e[0]):
        near: dict[str, list[str]] = {}
        for _, a, b in level:
            near.setdefault(a, []).append(b)
        heads = [(left[1, a][-1], a) for a in near if left.get((1, a))]
        heapq.heapify(heads)
        while heads:
            _, a = heads[0]
            free = [(left[0, b][-1], b) for b in near[a] if left.get((0, b))]
            if not free:
                heapq.heappop(heads)
                continue
            left[0, min(free)[1]].pop()
            humans = left[1, a]
            humans.pop()
            taken += 1
            if humans:
                heapq.heapreplace(heads, (humans[-1], a))
            else:
                heapq.heappop(heads)
    return taken


def _matched(edges: pd.Series, values: pd.Series) -> pd.Series:
    of = lambda rows: [tuple(r.values()) for r in rows]
    return pd.Series([match(of(e), of(v)) for e, v in zip(edges, values, strict=True)], dtype="int64")


class Matching:
    """Values put together by group; `scores` gives the counts of each group by one similarity."""

    def __init__(self, values: DataFrame, methods: tuple[str, ...] = ("max_all",), group: tuple[str, ...] = GROUP) -> None:
        self.group = list(group)
        place = F.concat_ws("/", *[F.format_string("%012d", F.coalesce(F.col(c), F.lit(0)).cast("long")) if c != "artifact_id" else _id_place() for c in (*(("issue_number",) if "issue_number" not in group else ()), *ORDER)])
        self.values = values.select(*group, "h", "phrase", place.alias("pos"))
        each = cut(self.values.groupBy(*group, "phrase").agg(F.sum("h").alias("n_a"), F.sum(1 - F.col("h")).alias("n_b")))  # one row per phrase
        self.counts = each.groupBy(*group).agg(F.sum("n_a").alias("human_count"), F.sum("n_b").alias("model_count"))
        a, b = (each.where(f"n_{x} > 0").select(*group, F.col("phrase").alias(x), f"n_{x}") for x in "ab")
        met = a.join(b, self.group)
        names = [f"{w}_{m}" for m in methods for w in "fb"]
        other = met.where("a <> b")
        known = similarities(other.select("a", "b").distinct(), methods)
        equal = met.where("a = b").select(*group, "a", "b", "n_a", "n_b", *[F.lit(1.0).alias(n) for n in names])
        self.met = cut(other.join(known, ["a", "b"]).select(*group, "a", "b", "n_a", "n_b", *names).unionByName(equal))

    def scores(self, method: str = "max_all", threshold: float = 0.82) -> DataFrame:
        """group, human_count, model_count, tp, sum_best_human, sum_best_model."""
        group = self.group
        met = self.met.select(*group, "a", "b", "n_a", "n_b", F.col(f"f_{method}").alias("forward"), F.col(f"b_{method}").alias("backward"))
        sides = F.array(F.struct(F.lit(1).alias("side"), F.col("a").alias("phrase"), F.col("forward").alias("s"), F.col("n_a").alias("n")), F.struct(F.lit(0).alias("side"), F.col("b").alias("phrase"), F.col("backward").alias("s"), F.col("n_b").alias("n")))
        best = met.select(*group, F.inline(sides)).groupBy(*group, "side", "phrase").agg(F.max("s").alias("s"), F.first("n").alias("n"))
        sums = best.groupBy(*group).agg(*[F.sum(F.when(F.col("side") == k, F.col("s") * F.col("n")).otherwise(0.0)).alias(c) for k, c in ((1, "sum_best_human"), (0, "sum_best_model"))])
        near = met.where(F.col("forward") >= threshold)
        degree = lambda x: F.count("*").over(Window.partitionBy(*group, x))
        near = near.withColumns({"d_a": degree("a"), "d_b": degree("b")})
        alone = (F.col("d_a") == 1) & (F.col("d_b") == 1)
        simple = near.where(alone).groupBy(*group).agg(F.sum(F.least("n_a", "n_b")).alias("tp"))
        hard = near.where(~alone).select(*group, "a", "b", "forward")
        edges = hard.groupBy(*group).agg(F.collect_list(F.struct((-F.col("forward")).alias("s"), "a", "b")).alias("edges"))
        wanted = hard.select(*group, F.explode(F.array(F.struct(F.lit(1).alias("h"), F.col("a").alias("phrase")), F.struct(F.lit(0).alias("h"), F.col("b").alias("phrase")))).alias("w")).select(*group, "w.*").distinct()
        held = self.values.join(wanted, [*group, "h", "phrase"], "left_semi").groupBy(*group).agg(F.collect_list(F.struct("h", "phrase", "pos")).alias("held"))
        fold = F.pandas_udf(_matched, "long")
        matched = simple.unionByName(edges.join(held, group).select(*group, fold("edges", "held").alias("tp"))).groupBy(*group).agg(F.sum("tp").alias("tp"))
        out = self.counts.join(matched, group, "left").join(sums, group, "left")
        return out.fillna(0, ["tp"]).fillna(0.0, ["sum_best_human", "sum_best_model"])


def _id_place() -> Column:
    """artifact_id in an order that is its own: numbers by value, texts as they are."""
    return F.coalesce(F.format_string("%020d", F.col("artifact_id").try_cast("bigint")), F.col("artifact_id").cast("string"), F.lit(""))


def group_scores(values: DataFrame, threshold: float = 0.82, method: str = "max_all", group: tuple[str, ...] = GROUP) -> DataFrame:
    """Per group: human_count, model_count, tp, sum_best_model, sum_best_human."""
    return Matching(values, (method,), group).scores(method, threshold)


def pooled(scores: DataFrame, *keys: str) -> DataFrame:
    """Hard and soft scores from counts added up over groups."""
    s = scores.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("human_count", "model_count", "tp", "sum_best_human", "sum_best_model")])
    fp, fn = F.col("model_count") - F.col("tp"), F.col("human_count") - F.col("tp")
    p, r = X.ratio("tp", "model_count"), X.ratio("tp", "human_count")
    soft = lambda n, x: F.when(F.col(n) == 0, 1.0).otherwise(F.col(x) / F.col(n))
    sp, sr = soft("model_count", "sum_best_model"), soft("human_count", "sum_best_human")
    return s.select(
        *keys, "human_count", "model_count", "tp", fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), X.harmonic(p, r).alias("f1"), X.ratio("tp", F.col("tp") + fp + fn).alias("jaccard"),
        sp.alias("soft_precision"), sr.alias("soft_recall"), X.harmonic(sp, sr).alias("soft_f1"),
    )


def per_issue(aligned: DataFrame, threshold: float = 0.82, method: str = "max_all") -> DataFrame:
    """Pooled scores of each issue; an issue without any value has counts of 0 and scores of 1."""
    scores = group_scores(field_values(aligned), threshold, method)
    none = aligned.select(*ISSUE).distinct().select(*ISSUE, F.lit("").alias("type"), F.lit("").alias("field"), *[F.lit(0).cast("long").alias(c) for c in ("human_count", "model_count")], F.lit(0).alias("tp"), *[F.lit(0.0).alias(c) for c in ("sum_best_human", "sum_best_model")])
    return pooled(scores.unionByName(none), *ISSUE)


def overall(aligned: DataFrame, threshold: float = 0.82, method: str = "max_all") -> DataFrame:
    """Pooled scores of each target after putting the values of all its issues together and matching them anew."""
    return pooled(group_scores(field_values(aligned), threshold, method, (*TARGET, "type", "field")), *TARGET)


def macro(issues: DataFrame) -> DataFrame:
    """Means over issues."""
    return issues.groupBy(*TARGET).agg(F.count("*").alias("issue_count"), *[X.mean(c).alias(c) for c in ("precision", "recall", "f1", "jaccard", "soft_precision", "soft_recall", "soft_f1")])


def per_issue_type(aligned: DataFrame, threshold: float = 0.82, method: str = "max_all") -> DataFrame:
    """Pooled scores of each type of each issue, where it has values."""
    return pooled(group_scores(field_values(aligned), threshold, method), *ISSUE, "type")


def all_methods(aligned: DataFrame, threshold: float = 0.82) -> DataFrame:
    """Means over issues by each similarity, with ``method``; phrases meet once and similarities are worked out once for all."""
    matching, every = Matching(field_values(aligned), METHODS), cut(aligned.select(*ISSUE).distinct())
    out = None
    for method in METHODS:
        issues = every.join(pooled(matching.scores(method, threshold), *ISSUE), list(ISSUE), "left")
        scores = ("precision", "recall", "f1", "jaccard", "soft_precision", "soft_recall", "soft_f1")
        part = macro(issues.fillna(1.0, list(scores))).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out
