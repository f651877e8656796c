"""Agreement on tags, on types that both sides have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators.align import ISSUE
from threadloom.operators.type_metrics import TARGET


def tag_counts(aligned: DataFrame) -> DataFrame:
    """Per issue and type: has_h, has_l, shared, and (on shared types) the sizes of the tag sets and of their intersection.

    The empty tag stands for the type itself, so that types without tags are counted too. Takes artifacts (`aligned`) or their tags
    (`tag_sets`); an issue without any type has a row with a null type and counts of 0.
    """
    each = aligned if "tag" in aligned.columns else aligned.withColumn("tag", F.explode(F.concat(F.array(F.lit("")), "tags")))
    flags = each.groupBy(*ISSUE, "type", "tag").agg(F.max("h").alias("h"), F.max("l").alias("l"))
    real, none = F.col("tag") != "", F.col("tag") == ""
    c = flags.groupBy(*ISSUE, "type").agg(
        F.coalesce(F.max(F.when(none, F.col("h"))), F.lit(0)).alias("has_h"),
        F.coalesce(F.max(F.when(none, F.col("l"))), F.lit(0)).alias("has_l"),
        F.sum(F.when(real, F.col("h") * F.col("l")).otherwise(0)).alias("both"),
        F.sum(F.when(real, F.col("h")).otherwise(0)).alias("human"),
        F.sum(F.when(real, F.col("l")).otherwise(0)).alias("model"),
    )
    shared = F.col("has_h") * F.col("has_l")
    return c.select(*ISSUE, "type", "has_h", "has_l", shared.alias("shared"), *[(F.col(x) * shared).alias(x) for x in ("both", "human", "model")])


def pooled(counts: DataFrame) -> DataFrame:
    """Scores on pooled counts at three levels in one pass: ``overall``, ``issue`` and ``type`` of each target.

    Where nothing is shared, the pooled counts are 0 and all scores 1.
    """
    sums = counts.sparkSession.sql("""
        SELECT model_id, repository, issue_number, type,
          CASE 2 * grouping(issue_number) + grouping(type) WHEN 3 THEN 'overall' WHEN 1 THEN 'issue' ELSE 'type' END AS level,
          sum(shared) AS compared_count, sum(has_h) AS human_issue_count, sum(has_l) AS model_issue_count,
          sum(both) AS intersection_count, sum(human) AS human_count, sum(model) AS model_count
        FROM {counts}
        GROUP BY GROUPING SETS ((model_id, repository), (model_id, repository, issue_number), (model_id, repository, type))
        HAVING grouping(type) = 1 OR type IS NOT NULL""", counts=counts)
    s = X.set_scores("intersection_count", "human_count", "model_count")
    return sums.select("level", *ISSUE, "type", "compared_count", "human_issue_count", "model_issue_count", "intersection_count", "human_count", "model_count", *[c.alias(n) for n, c in s.items()])


def macro(counts: DataFrame, empty: float = 1.0, by_type: bool = False) -> DataFrame:
    """Means over issues of the issue's pooled scores, or (`by_type`) of the mean over its shared types; `empty` is the score of
    an issue without a shared type."""
    names = ("precision", "recall", "f1", "jaccard")
    if by_type:
        each = counts.where("shared = 1").select(*ISSUE, *[c.alias(n) for n, c in X.set_scores("both", "human", "model").items()])
        issue = each.groupBy(*ISSUE).agg(*[F.avg(n).alias(n) for n in names])
        issue = counts.select(*ISSUE).distinct().join(issue, list(ISSUE), "left").fillna(empty, list(names))
    else:
        sums = counts.groupBy(*ISSUE).agg(F.sum("shared").alias("n"), *[F.sum(c).alias(c) for c in ("both", "human", "model")])
        issue = sums.select(*ISSUE, *[F.when(F.col("n") == 0, F.lit(empty)).otherwise(c).alias(k) for k, c in X.set_scores("both", "human", "model").items()])
    return issue.groupBy(*TARGET).agg(F.count("*").alias("issue_count"), *[X.mean(n).alias(n) for n in names])


def frequency(aligned: DataFrame, k: int | None = None) -> DataFrame:
    """Mentions of each tag by side and model, with the total; the k tags of the greatest total (ties by name), or all.

    Human mentions count once, whatever the number of models.
    """
    each = aligned.select("repository", "model_id", "h", "artifact_id", F.explode("tags").alias("tag"))
    human = each.where("h = 1").select("artifact_id", "tag").distinct().groupBy("tag").agg(F.count("*").alias("human_mentions"))
    model = each.where("h = 0").groupBy("tag").agg(F.count("*").alias("model_mentions"))
    out = human.join(model, "tag", "full_outer").fillna(0, ["human_mentions", "model_mentions"]).withColumn("total", F.col("human_mentions") + F.col("model_mentions"))
    return out if k is None else out.orderBy(F.desc("total"), "tag").limit(k)
