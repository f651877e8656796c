"""Agreement on artifact types: per issue, on average, on the vocabulary, per type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators.align import ISSUE

TARGET = ("model_id", "repository")


def type_flags(aligned: DataFrame) -> DataFrame:
    """Per issue and type whether the human and the model side have it; of artifacts (`aligned`) or their types (`type_sets`)."""
    return aligned.groupBy(*ISSUE, "type").agg(F.max("h").alias("h"), F.max("l").alias("l"))


def _scores(counted: DataFrame, *keys: str) -> DataFrame:
    s = X.set_scores("intersection_count", "human_count", "model_count")
    return counted.select(*keys, "intersection_count", "human_count", "model_count", (F.col("human_count") + F.col("model_count") - F.col("intersection_count")).alias("union_count"), *[c.alias(n) for n, c in s.items()])


def _counted(flags: DataFrame, *keys: str) -> DataFrame:
    return flags.groupBy(*keys).agg(F.sum(F.col("h") * F.col("l")).alias("intersection_count"), F.sum("h").alias("human_count"), F.sum("l").alias("model_count"))


def per_issue(flags: DataFrame) -> DataFrame:
    """Set scores of each issue; an issue that only one side has is compared with the empty set."""
    return _scores(_counted(flags, *ISSUE), *ISSUE)


def macro(issues: DataFrame) -> DataFrame:
    """Means over the issues of a target."""
    return issues.groupBy(*TARGET).agg(F.count("*").alias("issue_count"), *[X.mean(c).alias(c) for c in ("precision", "recall", "f1", "jaccard")])


def vocabulary(flags: DataFrame) -> DataFrame:
    """Set scores of the types that each side uses anywhere in the target."""
    return _scores(_counted(flags.groupBy(*TARGET, "type").agg(F.max("h").alias("h"), F.max("l").alias("l")), *TARGET), *TARGET)


def per_type(flags: DataFrame) -> DataFrame:
    """Confusion counts of each type over the issues of a target; true negatives by subtraction, not by a cross join."""
    issues = flags.groupBy(*TARGET).agg(F.count_distinct("issue_number").alias("issues"))
    c = flags.where("type is not null").groupBy(*TARGET, "type").agg(F.sum(F.col("h") * F.col("l")).alias("tp"), F.sum((1 - F.col("h")) * F.col("l")).alias("fp"), F.sum(F.col("h") * (1 - F.col("l"))).alias("fn"))
    s = X.set_scores("tp", F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"))
    return c.join(issues, list(TARGET)).select(*TARGET, "type", "tp", "fp", "fn", (F.col("issues") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), *[x.alias(n) for n, x in s.items()])
