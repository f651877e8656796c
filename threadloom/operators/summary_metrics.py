"""Agreement on summaries, scored on types that both sides have.

The scorer is a plug: a function of two columns that gives a struct of doubles. The default is lexical. Neural scorers need
weights that aren't here; `unavailable` gives their contract: zeros with a flag.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators.align import ISSUE, ORDER
from threadloom.operators.type_metrics import TARGET

Scorer = Callable[[Column, Column], Column]


def lexical(a: Column, b: Column) -> Column:
    """Token F1 and trigram Jaccard of the two texts as phrases, and the former through the logistic curve."""

    def scores(p: Column) -> Column:
        s = X.similarities(p["a"], p["b"])
        return F.struct(s["token_f1"].alias("token_f1"), s["char_ngram_jaccard"].alias("trigram"))

    # phrases and scores are worked out once each: texts may be long
    once = X.let(F.struct(X.phrase(a).alias("a"), X.phrase(b).alias("b")), scores)
    return X.let(once, lambda s: F.struct(s["token_f1"].alias("token_f1"), s["trigram"].alias("trigram"), X.logistic_score(s["token_f1"]).alias("logistic")))


def unavailable(a: Column, b: Column) -> Column:
    """Zeros and the flag, for a scorer whose model can't be loaded."""
    return F.struct(F.lit(0.0).alias("score"), F.lit(1.0).alias("unavailable"))


def with_empty_texts(scorer: Scorer, names: tuple[str, ...]) -> Scorer:
    """The scorer on two texts with something in them; two blank ones score 1, a blank beside another 0."""

    def score(a: Column, b: Column) -> Column:
        blank = [F.coalesce(X.strip(x), F.lit("")) == "" for x in (a, b)]
        same = lambda v: F.struct(*[F.lit(v).alias(n) for n in names])
        return F.when(blank[0] & blank[1], same(1.0)).when(blank[0] | blank[1], same(0.0)).otherwise(scorer(a, b))

    return score


def vector_scores(human: pd.Series, model: pd.Series) -> pd.DataFrame:
    """precision, recall, f1 by greatest cosine, and the cosine of the means (clipped to [-1, 1]), of two lists of token vectors.

    Recall is the mean over the human tokens of the greatest cosine with a model token, precision the other way. Two empty lists score
    1, one empty list 0; null vectors (masked tokens) are left out.
    """
    out = []
    for x, y in zip(human, model, strict=True):
        a, b = (np.array([v for v in (z if z is not None else []) if v is not None], np.float64) for z in (x, y))
        if not len(a) or not len(b):
            out.append((float(len(a) == len(b)),) * 4)
            continue
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
        c = unit(a) @ unit(b).T
        p, r = float(c.max(0).mean()), float(c.max(1).mean())
        mean = float(np.clip(unit(a.mean(0)) @ unit(b.mean(0)), -1, 1))
        out.append((p, r, 2 * p * r / (p + r) if p + r else 0.0, mean))
    return pd.DataFrame(out, columns=["precision", "recall", "f1", "cosine"])


def token_similarity(a: Column, b: Column) -> Column:
    """`vector_scores` of two columns of token vectors."""
    return F.pandas_udf(vector_scores, "struct<precision: double, recall: double, f1: double, cosine: double>")(a, b)


def hashed_tokens(text: Column, width: int = 16) -> Column:
    """Token vectors that need no model: each token by the first bytes of its hash, as numbers around 0; null for no token."""
    digit = lambda h, k: F.conv(F.substring(h, k * 2 + 1, 2), 16, 10).cast("double") / 127.5 - 1
    return F.transform(X.search_tokens(F.coalesce(text, F.lit(""))), lambda t: X.let(F.md5(t), lambda h: F.array(*[digit(h, k) for k in range(width)])))


def vectors(a: Column, b: Column) -> Column:
    """A scorer by token vectors, here hashed ones; the vectors of an encoder go the same way (`token_similarity`)."""
    return token_similarity(hashed_tokens(a), hashed_tokens(b))


def combined(aligned: DataFrame, keys: tuple[str, ...] = (*ISSUE, "type")) -> DataFrame:
    """Per key the summaries of each side in order, joined by line ends, and their numbers; blank summaries don't count."""
    a = aligned.withColumn("text", X.strip("summary")).where("text is not null and text <> ''")
    order = [c for c in ("issue_number", *ORDER) if c not in keys]
    side = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(flag) == 1, F.struct(*order, "text")))), lambda r: r["text"]), "\n")
    return a.groupBy(*keys).agg(F.sum("h").alias("human_n"), F.sum("l").alias("model_n"), side("h").alias("human_text"), side("l").alias("model_text"))


def pairs(aligned: DataFrame, scorer: Scorer = lexical) -> DataFrame:
    """Scores of the shared types of each issue, with the weight of each (its human summaries)."""
    c = combined(aligned).where("human_n > 0 and model_n > 0")
    return c.select(*ISSUE, "type", "human_n", "model_n", F.greatest("human_n", F.lit(1)).cast("double").alias("weight"), scorer(F.col("human_text"), F.col("model_text")).alias("scores"))


def per_issue(aligned: DataFrame, scorer: Scorer = lexical, names: tuple[str, ...] = ("token_f1", "trigram", "logistic")) -> DataFrame:
    """Coverage of the types, and of each score the mean, the weighted mean and the mean times the coverage recall."""
    kinds = combined(aligned).select(*ISSUE, "type", (F.col("human_n") > 0).cast("int").alias("h"), (F.col("model_n") > 0).cast("int").alias("l"))
    count = kinds.groupBy(*ISSUE).agg(F.sum("h").alias("human_types"), F.sum("l").alias("model_types"), F.sum(F.col("h") * F.col("l")).alias("matched_types"))
    scored = pairs(aligned, scorer).groupBy(*ISSUE).agg(
        *[F.avg(f"scores.{n}").alias(n) for n in names], *[F.try_divide(F.sum(F.col("weight") * F.col(f"scores.{n}")), F.sum("weight")).alias("weighted_" + n) for n in names]
    )
    every = aligned.select(*ISSUE).distinct().join(count, list(ISSUE), "left").join(scored, list(ISSUE), "left").fillna(0)
    p, r = X.ratio("matched_types", "model_types"), X.ratio("matched_types", "human_types")
    penalised = [(F.col(n) * F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))).alias("penalised_" + n) for n in names]
    return every.select(*ISSUE, "human_types", "model_types", "matched_types", p.alias("type_precision"), r.alias("type_recall"), X.harmonic(p, r).alias("type_f1"), *names, *["weighted_" + n for n in names], *penalised)


def per_type(aligned: DataFrame, scorer: Scorer = lexical, names: tuple[str, ...] = ("token_f1", "trigram", "logistic")) -> DataFrame:
    """Each type scored once, on the summaries of the issues where both sides have it; recall over the issues where the human has."""
    flags = combined(aligned).select(*ISSUE, "type", F.col("human_n") > 0, F.col("model_n") > 0).toDF(*ISSUE, "type", "h", "l")
    count = flags.groupBy(*TARGET, "type").agg(F.count_if("h").alias("human_issues"), F.count_if("l").alias("model_issues"), F.count_if(F.col("h") & F.col("l")).alias("matched_issues"))
    shared = flags.where("h and l").select(*ISSUE, "type")
    texts = combined(aligned.join(shared, [*ISSUE, "type"], "left_semi"), (*TARGET, "type"))
    scored = texts.select(*TARGET, "type", scorer(F.col("human_text"), F.col("model_text")).alias("s"))
    out = count.join(scored.select(*TARGET, "type", *[F.col(f"s.{n}").alias(n) for n in names]), [*TARGET, "type"], "left").fillna(0.0, list(names))
    recall = X.ratio("matched_issues", "human_issues")
    return out.select(*TARGET, "type", "human_issues", "model_issues", "matched_issues", recall.alias("issue_recall"), *names, *[(F.col(n) * recall).alias("penalised_" + n) for n in names])


def overall(issues: DataFrame, types: DataFrame, name: str = "token_f1") -> DataFrame:
    """The eight blocks of one score per target."""
    w = F.col("matched_types").cast("double")
    matched = F.col("matched_types") > 0
    a = issues.groupBy(*TARGET).agg(
        F.coalesce(F.avg(F.when(matched, F.col(name))), F.lit(0.0)).alias("matched_only_macro"),
        X.mean("penalised_" + name).alias("all_issues_with_penalty"),
        X.mean(name).alias("all_issues_raw"),
        F.coalesce(F.try_divide(F.sum(w * F.col("weighted_" + name)), F.sum(w)), F.lit(0.0)).alias("support_weighted"),
        *[X.mean(c).alias("coverage_" + c.removeprefix("type_")) for c in ("type_precision", "type_recall", "type_f1")],
    )
    b = types.groupBy(*TARGET).agg(F.coalesce(F.avg(F.when(F.col("matched_issues") > 0, F.col(name))), F.lit(0.0)).alias("per_type_matched_only"), X.mean("penalised_" + name).alias("per_type_with_penalty"))
    a = a.withColumn("penalised_overall", F.col("matched_only_macro") * F.least(F.greatest("coverage_recall", F.lit(0.0)), F.lit(1.0)))
    return a.join(b, list(TARGET), "left").fillna(0.0, ["per_type_matched_only", "per_type_with_penalty"])
