"""Rule extraction (the reference side) against another extraction of the same issues (the candidate).

Both sides are tables of artifacts ``repository, issue_number, comment_idx, artifact_idx, type, summary, tags, metadata``. They
are put side by side as `align` does it, rules as ``h``, so every metric plan is used as it is, with three settings: values
``unknown`` are dropped, tags are averaged over shared types, and an issue without a shared type scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators import metadata_metrics, summary_metrics, tag_metrics, type_metrics
from threadloom.operators.align import ISSUE

FIELDS = ("repository", "issue_number", "comment_idx", "artifact_idx", "type", "summary", "tags", "metadata")


def side_by_side(reference: DataFrame, candidate: DataFrame, name: str = "candidate") -> DataFrame:
    """Both sides with flags, under one model name."""
    pick = lambda df, h: df.select(*FIELDS, F.xxhash64(*FIELDS[:4]).alias("artifact_id"), F.lit(name).alias("model_id"), F.lit(h).alias("h"), F.lit(1 - h).alias("l"))
    return pick(reference, 1).unionByName(pick(candidate, 0))


def counts(both: DataFrame) -> DataFrame:
    """Artifacts of each side per issue, their ratio and difference."""
    c = both.groupBy(*ISSUE).agg(F.sum("h").alias("reference_artifacts"), F.sum("l").alias("candidate_artifacts"))
    return c.withColumns({"count_ratio": X.ratio("candidate_artifacts", "reference_artifacts"), "count_delta": F.col("candidate_artifacts") - F.col("reference_artifacts")})


def tag_issue(both: DataFrame) -> DataFrame:
    """Mean tag scores over the shared types of each issue, 0 without one."""
    c = tag_metrics.tag_counts(both)
    s = X.set_scores("both", "human", "model")
    return c.groupBy(*ISSUE).agg(*[F.coalesce(F.avg(F.when(F.col("shared") == 1, v)), F.lit(0.0)).alias("tag_" + k) for k, v in s.items()])


METADATA = ("precision", "recall", "f1", "jaccard", "soft_precision", "soft_recall", "soft_f1")


def per_issue(both: DataFrame, threshold: float = 0.82, method: str = "max_all") -> DataFrame:
    """Counts, type, tag, metadata and penalised summary scores of each issue."""
    types = type_metrics.per_issue(type_metrics.type_flags(both)).select(*ISSUE, *[F.col(c).alias("type_" + c) for c in ("precision", "recall", "f1", "jaccard")])
    values = metadata_metrics.group_scores(metadata_metrics.field_values(both, drop_unknown=True), threshold, method)
    meta = metadata_metrics.pooled(values, *ISSUE).select(*ISSUE, *[F.col(c).alias("metadata_" + c) for c in METADATA])
    coverage = [F.col("type_" + c).alias("summary_coverage" + n) for c, n in (("recall", ""), ("precision", "_precision"), ("f1", "_f1"))]
    summary = summary_metrics.per_issue(both).select(*ISSUE, F.col("penalised_token_f1").alias("summary_f1"), *coverage)
    out = counts(both).join(types, list(ISSUE)).join(tag_issue(both), list(ISSUE))
    # an issue without any value compares nothing with nothing
    return out.join(meta, list(ISSUE), "left").fillna(1.0, ["metadata_" + c for c in METADATA]).join(summary, list(ISSUE))


MEANS = ("count_ratio", "count_delta", "type_precision", "type_recall", "type_f1", "type_jaccard", "tag_precision", "tag_recall", "tag_f1", "tag_jaccard", *["metadata_" + c for c in METADATA], "summary_f1", "summary_coverage", "summary_coverage_precision", "summary_coverage_f1")


def macro(issues: DataFrame) -> DataFrame:
    """Means over the issues of each repository, with the added counts."""
    have = [c for c in MEANS if c in issues.columns]
    return issues.groupBy("repository").agg(F.count("*").alias("issue_count"), F.sum("reference_artifacts").alias("reference_artifacts"), F.sum("candidate_artifacts").alias("candidate_artifacts"), *[X.mean(c).alias(c) for c in have])


def overall(issues: DataFrame, comments: DataFrame) -> DataFrame:
    """Per repository the added counts, the ratio and difference of the sums, and the means over issues.

    comments: repository, issue_number, reference_comments, candidate_comments. Summary scores of issues are penalised already:
    ``summary_all_issues`` is their mean. As in the reference, its own penalised mean is always 0 and ``penalized_overall``
    penalises twice; both stand under ``compat``.
    """
    matched = F.when(F.col("summary_coverage") > 0, F.col("summary_f1"))
    have = [c for c in MEANS if not c.startswith(("count_", "summary_"))]
    each = issues.join(comments, ["repository", "issue_number"], "left")
    sums = ("reference_comments", "candidate_comments", "reference_artifacts", "candidate_artifacts")
    o = each.groupBy("repository").agg(
        F.count("*").alias("issue_count"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[X.mean(c).alias(c) for c in have],
        F.coalesce(F.avg(matched), F.lit(0.0)).alias("summary_matched_only"), X.mean("summary_f1").alias("summary_all_issues"),
        *[X.mean(c).alias(c) for c in ("summary_coverage", "summary_coverage_precision", "summary_coverage_f1")],
    )
    o = o.withColumns({"count_ratio": X.ratio("candidate_artifacts", "reference_artifacts"), "count_delta": F.col("candidate_artifacts") - F.col("reference_artifacts")})
    return o.withColumns({"compat_all_issues_with_penalty": F.lit(0.0), "compat_penalised_overall": F.col("summary_matched_only") * F.col("summary_coverage")})


def tag_frequency(both: DataFrame) -> DataFrame:
    """Mentions of each tag by either side, per repository."""
    return both.select("repository", "h", "l", F.explode("tags").alias("tag")).groupBy("repository", "tag").agg(F.sum("h").alias("reference_mentions"), F.sum("l").alias("candidate_mentions"))


def per_type(both: DataFrame, threshold: float = 0.82, method: str = "max_all") -> DataFrame:
    """For each type the mean over issues where either side has it: type, tag, metadata and penalised summary scores.

    A type without metadata values compares nothing with nothing. Summaries are compared where both sides have the type, blank
    ones as empty texts; elsewhere they score 0.
    """
    key = [*ISSUE, "type"]
    c = tag_metrics.tag_counts(both)
    t = X.set_scores(F.col("has_h") * F.col("has_l"), "has_h", "has_l")
    s = X.set_scores("both", "human", "model")
    tag = [F.avg(F.when(F.col("shared") == 1, v).otherwise(0.0)).alias("tag_" + k) for k, v in s.items()]
    values = metadata_metrics.group_scores(metadata_metrics.field_values(both, drop_unknown=True), threshold, method)
    meta = metadata_metrics.pooled(values, *key).select(*key, *[F.col(m).alias("metadata_" + m) for m in METADATA])
    texts = summary_metrics.combined(both).select(*key, "human_text", "model_text")
    each = c.join(meta, key, "left").fillna(1.0, ["metadata_" + m for m in METADATA]).join(texts, key, "left").fillna("", ["human_text", "model_text"])
    each = each.withColumn("scores", F.when(F.col("shared") == 1, summary_metrics.lexical(F.col("human_text"), F.col("model_text"))))
    summary = [F.avg(F.coalesce(F.col(f"scores.{n}"), F.lit(0.0))).alias(a) for n, a in (("token_f1", "summary_f1"), ("trigram", "summary_trigram"), ("logistic", "summary_logistic"))]
    return each.groupBy("type").agg(F.count("*").alias("issue_count"), *[F.avg(v).alias("type_" + k) for k, v in t.items()], *tag, *[F.avg("metadata_" + m).alias("metadata_" + m) for m in METADATA], *summary)
