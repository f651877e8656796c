"""Leaderboards by reciprocal rank fusion over components ``repository, model_id, component, value``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X


def unpivot(reports: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Component rows from (component, report by model_id and repository, its column); null and non-finite values drop out."""
    each = [r.select("repository", "model_id", F.lit(c).alias("component"), F.col(v).cast("double").alias("value")) for c, r, v in reports]
    return reduce(DataFrame.unionByName, each).where("abs(value) < double('infinity')")


def ranked(components: DataFrame) -> DataFrame:
    """With the rank of each model in its repository and component: greater values first, ties by name."""
    return components.withColumn("rank", F.row_number().over(Window.partitionBy("repository", "component").orderBy(F.desc("value"), "model_id")))


def _points(scored: DataFrame, keys: list[str], points_max: int, points_step: int) -> DataFrame:
    step, most = max(1, points_step), max(1, points_max)
    part = F.when(F.col("max_score") <= 0, 0.0).otherwise(F.col("score") / F.col("max_score"))
    over = Window.partitionBy(*keys).orderBy(F.desc("score"), "model_id")
    p = scored.withColumns({"rank": F.row_number().over(over), "normalized_score": part * 100, "points": X.quantise(part * most, step, most).cast("long")})
    return p.withColumn("points_to_leader", F.first("points").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.col("points"))


def per_repository(components: DataFrame, k: int = 60, points_max: int = 100, points_step: int = 1) -> DataFrame:
    """repository, rank, model_id, score, max_score, normalized_score, points, points_to_leader."""
    k = max(1, k)
    r = ranked(components)
    score = r.groupBy("repository", "model_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"))
    best = r.groupBy("repository").agg((F.count_distinct("component") / (k + 1)).alias("max_score"))
    return _points(score.join(best, "repository"), ["repository"], points_max, points_step).select("repository", "rank", "model_id", "score", "max_score", "normalized_score", "points", "points_to_leader")


def combined(components: DataFrame, k: int = 60, points_max: int = 100, points_step: int = 1) -> DataFrame:
    """The same over all repositories at once, with the number of repositories of each model."""
    k = max(1, k)
    r = ranked(components)
    score = r.groupBy("model_id").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.count_distinct("repository").alias("repo_count"))
    best = r.select("repository", "component").distinct().agg((F.count("*") / (k + 1)).alias("max_score"))
    one = score.withColumn("all", F.lit(1)).join(best.withColumn("all", F.lit(1)), "all")
    return _points(one, ["all"], points_max, points_step).select("rank", "model_id", "score", "max_score", "normalized_score", "points", "points_to_leader", "repo_count")


def component_means(components: DataFrame) -> DataFrame:
    """Mean value of each component per model over its repositories."""
    return components.groupBy("model_id", "component").agg(F.avg("value").alias("value"))


def profile_points(components: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Per model the mean of the named components, missing ones as 0, in points of 100 by half-even rounding."""
    wide = component_means(components).groupBy("model_id").pivot("component", list(names)).agg(F.first("value")).fillna(0.0)
    mean = reduce(lambda a, b: a + b, [F.col(n) for n in names]) / len(names)
    return wide.select("model_id", *names, mean.alias("composite"), F.bround(mean * 100).cast("long").alias("points"))


def complete(components: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Components of the models and repositories that have all the named ones, as figures need them."""
    have = components.where(F.col("component").isin(*names)).groupBy("repository", "model_id").agg(F.count_distinct("component").alias("n")).where(F.col("n") == len(names))
    return components.join(have.select("repository", "model_id"), ["repository", "model_id"], "left_semi")
