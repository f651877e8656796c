"""Tables behind figures and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X


def dataset_stats(artifacts: DataFrame) -> DataFrame:
    """One row: repositories, models, issues, artifacts of each side, distinct tags and types."""
    each = artifacts.select("*", F.explode(F.concat(F.array(F.lit("")), "tags")).alias("tag"))
    own = F.col("tag") == ""
    return each.agg(
        F.count_distinct("repository").alias("repositories"),
        F.count_distinct("model_id").alias("models"),
        F.count_distinct("repository", "issue_number").alias("issues"),
        F.count_if(own & (F.col("side") == "human")).alias("human_artifacts"),
        F.count_if(own & (F.col("side") == "model")).alias("model_artifacts"),
        F.count_distinct("type").alias("types"),
        F.count_distinct(F.when(~own, F.col("tag"))).alias("tags"),
    )


def mean_by_type(per_type: DataFrame, metric: str) -> DataFrame:
    """Mean of a metric per model and type over repositories."""
    return per_type.groupBy("model_id", "type").agg(F.avg(metric).alias(metric), F.count("*").alias("repositories"))


def top_types(by_type: DataFrame, metric: str, k: int = 12) -> DataFrame:
    """The k types of the greatest metric for each model; ties by type."""
    over = Window.partitionBy("model_id").orderBy(F.desc(metric), "type")
    return by_type.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def spread(by_type: DataFrame, metric: str) -> DataFrame:
    """Types in an order in which neighbours on a ring differ, as ``place`` from 1.

    In order of the metric (ascending, then by name) they are cut into 4 runs of equal length, 5 from 20 types on; the runs are read
    side by side, first of each, second of each and so on, every second of these rows backwards. Six types or fewer stay as they are.
    """
    whole = Window.partitionBy("model_id")
    n, r = F.count("*").over(whole), F.row_number().over(whole.orderBy(F.coalesce(F.col(metric), F.lit(0.0)), "type")) - 1
    t = by_type.withColumns({"_n": n, "_r": r}).withColumn("_size", F.ceil(F.col("_n") / F.when(F.col("_n") >= 20, 5).otherwise(4)))
    few = F.col("_n") <= 6
    row, run = F.when(few, F.col("_r")).otherwise(F.col("_r") % F.col("_size")), F.when(few, 0).otherwise(F.floor(F.col("_r") / F.col("_size")))
    t = t.withColumns({"_row": row, "_run": F.when(row % 2 == 1, -run).otherwise(run)})
    return t.withColumn("place", F.row_number().over(whole.orderBy("_row", "_run"))).drop("_n", "_r", "_size", "_row", "_run")


def box_stats(per_issue: DataFrame, metric: str) -> DataFrame:
    """Quartiles, extremes and mean of a per-issue metric for each model."""
    q = lambda p: F.percentile(metric, F.lit(p))
    return per_issue.groupBy("model_id").agg(F.count("*").alias("issues"), F.min(metric).alias("least"), q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"), F.max(metric).alias("most"), X.mean(metric).alias("mean"))


def tag_shares(artifacts: DataFrame) -> DataFrame:
    """Mean mentions of each tag per repository: added up and divided by the number of all repositories."""
    n = artifacts.select("repository").distinct().agg(F.count("*").alias("repositories"))
    t = artifacts.select("side", F.explode("tags").alias("tag")).groupBy("side", "tag").agg(F.count("*").alias("mentions"))
    return t.withColumn("k", F.lit(1)).join(n.withColumn("k", F.lit(1)), "k").select("side", "tag", "mentions", (F.col("mentions") / F.col("repositories")).alias("per_repository"))


def cost_per_issue(costs: DataFrame) -> DataFrame:
    """model_id, total, requests to the cost of one issue; null without requests."""
    return costs.select("model_id", F.try_divide(F.col("total"), F.col("requests")).alias("cost_per_issue"))


def viewer_rows(raw: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Issues that have human artifacts, as rows for a page: title, counts per side, and the models' counts as JSON."""
    last = raw.groupBy("repository", "number").agg(F.max_by(F.struct("title", "state", "url"), F.struct("fetched_at", "snapshot_id")).alias("r"))
    human = artifacts.where("side = 'human'").groupBy("repository", "issue_number").agg(F.count("*").alias("human_artifacts"))
    model = artifacts.where("side = 'model'").groupBy("repository", "issue_number", "model_id").agg(F.count("*").alias("n"))
    model = model.groupBy("repository", "issue_number").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_id", "n"))))).alias("models"))
    j = last.withColumnRenamed("number", "issue_number").join(human, ["repository", "issue_number"]).join(model, ["repository", "issue_number"], "left")
    return j.select("repository", "issue_number", "r.title", "r.state", "r.url", "human_artifacts", F.coalesce("models", F.lit("{}")).alias("models"))


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<table id="t"><thead></thead><tbody></tbody></table>
<script id="data" type="application/json">{data}</script>
<script>
const rows = JSON.parse(document.getElementById("data").textContent), cols = rows.length ? Object.keys(rows[0]) : [];
const head = document.querySelector("#t thead"), body = document.querySelector("#t tbody");
const draw = () => {{ body.replaceChildren(...rows.map(r => {{ const tr = document.createElement("tr"); cols.forEach(c => tr.insertCell().textContent = r[c] ?? ""); return tr; }})); }};
const tr = head.insertRow();
cols.forEach(c => {{ const th = document.createElement("th"); th.textContent = c; th.onclick = () => {{ rows.sort((a, b) => (a[c] < b[c]) - (a[c] > b[c])); draw(); }}; tr.append(th); }});
draw();
</script>
"""


def page(rows: DataFrame, title: str, limit: int = 5_000) -> str:
    """A page with a report as a table that sorts by any column. The data can't end the script.

    A page holds `limit` rows; of a longer report it says how many rows aren't shown. Reports go to pages, tables of any size to `files`.
    """
    data = [r[0] for r in rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})).limit(limit + 1).collect()]
    if len(data) > limit:
        title, data = f"{title} (the first {limit} of {rows.count()} rows)", data[:limit]
    return PAGE.format(title=title.replace("<", "&lt;"), data=("[" + ",\n".join(data) + "]").replace("</", "<\\/"))


def tag_f1_by_type(counts: DataFrame) -> DataFrame:
    """Tag agreement of each model and type over all its issues: f1 = 2 both / (human + model), 1 if neither side has a tag."""
    s = counts.where("type is not null").groupBy("model_id", "type").agg(*[F.sum(c).alias(c) for c in ("both", "human", "model")])
    n = F.col("human") + F.col("model")
    return s.select("model_id", "type", F.when(n == 0, 1.0).otherwise(2 * F.col("both") / n).alias("f1"))


def issue_series(per_issue: DataFrame, metric: str) -> DataFrame:
    """The values of a metric of each model and repository in order of issues: model_id, repository, place (from 0), value."""
    over = Window.partitionBy("model_id", "repository").orderBy("issue_number")
    return per_issue.where(F.col(metric).isNotNull()).select("model_id", "repository", (F.row_number().over(over) - 1).alias("place"), F.col(metric).alias("value"))


def scatter(x: DataFrame, y: DataFrame) -> DataFrame:
    """Two series side by side by place, as long as the shorter: model_id, repository, place, x, y."""
    key = ["model_id", "repository", "place"]
    return x.withColumnRenamed("value", "x").join(y.withColumnRenamed("value", "y"), key)


def across_repositories(per_issue: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """Means over the issues of all repositories pooled, with their numbers."""
    return per_issue.agg(F.count_distinct("repository").alias("repositories"), F.count("*").alias("issues"), *[X.mean(m).alias(m) for m in metrics])


__all__ = ["across_repositories", "box_stats", "cost_per_issue", "dataset_stats", "issue_series", "mean_by_type", "page", "scatter", "spread", "tag_f1_by_type", "tag_shares", "top_types", "viewer_rows"]
