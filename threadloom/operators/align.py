"""Two annotators of the same issues, side by side.

Every metric starts from the last state of each artifact, human ones repeated for each model that is evaluated in their repository,
told apart by the flags ``h`` and ``l``. Scores of types and tags need their sets only (`type_sets`, `tag_sets`): these are made distinct before
the human side is repeated. Metadata and summaries need the artifacts themselves (`aligned`).

Types and tags are compared as they stand, only trimmed; ``normal`` compares them in small letters with underscores, as extraction writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X

ISSUE = ("model_id", "repository", "issue_number")
ORDER = ("comment_idx", "artifact_idx", "artifact_id")


def latest_artifacts(artifact: DataFrame, normal: bool = False) -> DataFrame:
    """One row per artifact_id, from the row with the greatest extracted_at; rows without an artifact_id drop out.

    A partial aggregate per task comes before the shuffle, so rows delivered many times cost little. type and tags are trimmed
    (normalised with `normal`), tags distinct; artifacts of a null or blank type or without an issue drop out.
    """
    rest = [c for c in ("side", "model_id", "repository", "issue_number", "comment_idx", "artifact_idx", "type", "summary", "tags", "metadata") if c in artifact.columns]
    order = F.struct("extracted_at", "type", F.coalesce("tags", F.array().cast("array<string>")), "summary")
    last = artifact.where("artifact_id is not null").groupBy("artifact_id").agg(F.max_by(F.struct(*rest), order).alias("r"))
    name = X.snake if normal else X.name
    tags = F.array_distinct(F.array_compact(F.transform(F.coalesce("r.tags", F.array().cast("array<string>")), name)))
    kept = [F.col(f"r.{c}").alias(c) for c in rest if c not in ("type", "tags")]
    return last.select("artifact_id", *kept, name("r.type").alias("type"), tags.alias("tags")).where("type is not null and issue_number is not null and repository is not null")


def empty_issues(artifact: DataFrame) -> DataFrame:
    """Issues that a side was asked about and found nothing in, as ``side, model_id, repository, issue_number``: rows without an
    artifact_id and a type. They count as empty sets."""
    return artifact.where("artifact_id is null and type is null and issue_number is not null and repository is not null").select("side", "model_id", "repository", "issue_number").distinct()


def targets(artifacts: DataFrame) -> DataFrame:
    """(model_id, repository) pairs to evaluate: those with at least one artifact (or empty issue) of the model."""
    return artifacts.where("side = 'model' and model_id is not null").select("model_id", "repository").distinct()


def _beside(a: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
    """Rows of both sides with the flags; human ones once for each target of their repository."""
    human = a.where("side = 'human'").select(*[c for c in names if c != "model_id"]).join(of, "repository")
    model = a.where("side = 'model' and model_id is not null")
    return human.select(*names, F.lit(1).alias("h"), F.lit(0).alias("l")).unionByName(model.select(*names, F.lit(0).alias("h"), F.lit(1).alias("l")))


def aligned(artifact: DataFrame, normal: bool = False) -> DataFrame:
    """Artifacts of both sides with ``model_id``, ``h`` and ``l``."""
    a = latest_artifacts(artifact, normal)
    return _beside(a, targets(a), [c for c in a.columns if c != "side"])


def _sets(artifact: DataFrame, normal: bool, *rest: Column) -> DataFrame:
    a, none = latest_artifacts(artifact, normal), empty_issues(artifact)
    key = ("side", "model_id", "repository", "issue_number")
    of = targets(a.select("side", "model_id", "repository").unionByName(none.select("side", "model_id", "repository")))
    each = a.select(*key, "type", *rest).distinct()
    names = [c for c in each.columns if c not in key]
    blank = none.select(*key, *[F.lit(None).cast(each.schema[c].dataType).alias(c) for c in names])
    flagged = _beside(each, of, [*ISSUE, *names])
    return flagged.unionByName(_beside(blank, of, [*ISSUE, *names]).withColumns({"h": F.lit(0), "l": F.lit(0)}))


def type_sets(artifact: DataFrame, normal: bool = False) -> DataFrame:
    """The types of each side of each issue, ``type`` null with flags of 0 for an issue in which a side has none."""
    return _sets(artifact, normal)


def tag_sets(artifact: DataFrame, normal: bool = False) -> DataFrame:
    """The same with ``tag``, the empty tag standing for the type itself."""
    return _sets(artifact, normal, F.explode(F.concat(F.array(F.lit("")), "tags")).alias("tag"))
