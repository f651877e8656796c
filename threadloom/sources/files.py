"""Scans and sinks of the stage folders: JSON documents, JSON lines, parquet stages."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTIFACT = "type string, summary string, tags array<string>, metadata map<string,string>"
EXTRACTION = (
    "repository string, model_id string, issue_number bigint, issue struct<issue_number: bigint, issue_title: string, issue_url: string, artifact_count: bigint, "
    f"comments: array<struct<comment_author: string, comment_link: string, status: string, error_type: string, error_message: string, artifacts: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ARTIFACT.split(', ', 3))}>>>>>"
)
RAW_ISSUE = (
    "number bigint, url string, title string, body string, state string, stateReason string, createdAt string, closedAt string, authorAssociation string, author struct<login: string>, labels array<struct<name: string>>, "
    "comments array<struct<id: string, url: string, body: string, createdAt: string, authorAssociation: string, author: struct<login: string>>>, "
    "timelineItems array<struct<__typename: string, createdAt: string, actor: struct<login: string>, willCloseTarget: boolean, stateReason: string, label: struct<name: string>, "
    "source: struct<__typename: string, number: bigint, url: string, title: string, state: string, merged: boolean, mergedAt: string>>>"
)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_documents(spark: SparkSession, folder: str, schema: str, pattern: str = "issue_*.json") -> DataFrame:
    """One JSON document per file, with ``file`` (its name) for the order of names; a folder that isn't there is empty."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    scan = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).json(folder)
    return scan.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines don't count."""
    return spark.read.schema(schema).json(path)


def issue_number(from_name: bool = True) -> Column:
    """The number inside the issue, else beside it, else (`from_name`) in the file's name; 0 counts as missing inside."""
    inside = [F.nullif(F.col("issue.issue_number"), F.lit(0)), F.col("issue_number")] if from_name else [F.col("issue.issue_number"), F.col("issue_number")]
    name = [F.regexp_extract("file", r"issue_(-?\d+)\.json$", 1).try_cast("bigint")] if from_name else []
    return F.coalesce(*inside, *name)


def extraction_artifacts(documents: DataFrame, from_name: bool = True) -> DataFrame:
    """Documents of one extraction side as artifact rows; documents without a number and null nodes drop out.

    A document without any artifact gives one row of its issue with all else null: a side that found nothing (`align.empty_issues`).
    """
    d = documents.withColumn("issue_number", issue_number(from_name)).where("issue_number is not null")
    key = ["repository", "model_id", "issue_number"]
    c = d.select("file", *key, F.posexplode_outer("issue.comments").alias("comment_idx", "c"))
    a = c.select("file", *key, "comment_idx", F.posexplode_outer("c.artifacts").alias("artifact_idx", "a"))
    some = a.where("a is not null").select(*key, "comment_idx", "artifact_idx", "a.type", "a.summary", "a.tags", "a.metadata")
    none = a.groupBy("file", *key).agg(F.count("a").alias("n")).where("n = 0").select(*key)
    return some.unionByName(none, allowMissingColumns=True)


def artifact_rows(rows: DataFrame, side: str) -> DataFrame:
    """`extraction_artifacts` of one side as the artifact table of the metrics: with side, artifact_id (null for an issue without
    artifacts) and no extraction time."""
    place = F.to_json(F.struct(F.lit(side).alias("side"), "repository", "model_id", "issue_number", "comment_idx", "artifact_idx"))
    return rows.select(F.when(F.col("artifact_idx").isNotNull(), place).alias("artifact_id"), F.lit(side).alias("side"), *rows.columns, F.lit(None).cast("timestamp").alias("extracted_at"))


#: The components of a board, the report file that each stands in, and its path there.
COMPONENTS = (
    ("type_f1", "type_matching", "macro_average.f1"),
    ("metadata_f1", "metadata_matching", "macro_average.f1"),
    ("metadata_soft_f1", "metadata_matching", "macro_average.soft_f1"),
    ("tag_f1", "tag_matching", "overall.f1"),
    ("summary_codebert", "summary_matching", "overall.all_issues_macro_with_unmatched_penalty.codebert.cosine"),
    ("summary_bertscore_f1", "summary_matching", "overall.all_issues_macro_with_unmatched_penalty.bertscore.f1"),
    ("summary_bleurt", "summary_matching", "overall.all_issues_macro_with_unmatched_penalty.bleurt.score"),
)


def report_components(spark: SparkSession, folder: str, complete: bool = False) -> DataFrame:
    """Components ``repository, model_id, component, value`` out of report files ``<model>/<repository>/<report>.json`` (names as folders).

    Absent files and paths, texts that are no number, NaN and infinities give no row. With `complete` only pairs that have all four
    report files count, as figures want it.
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], "repository string, model_id string, component string, value double")
    scan = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_matching.json").load(folder)
    parts = F.split(F.col("_metadata.file_path"), "/")
    name = lambda k: F.replace(F.url_decode(F.element_at(parts, -k)), F.lit("__"), F.lit("/"))
    files = scan.select(name(2).alias("repository"), name(3).alias("model_id"), F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.json$", 1).alias("report"), F.col("value").alias("json"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(r).alias("of"), F.get_json_object("json", f"$.{path}").try_cast("double").alias("value")) for c, r, path in COMPONENTS]))
    found = files.select("repository", "model_id", "report", each.alias("c")).where("c.of = report and abs(c.value) < double('infinity')")
    out = found.select("repository", "model_id", "c.component", "c.value")
    if complete:
        whole = files.groupBy("repository", "model_id").agg(F.count_distinct("report").alias("n")).where(F.col("n") == len({r for _, r, _ in COMPONENTS}))
        out = out.join(whole.select("repository", "model_id"), ["repository", "model_id"], "left_semi")
    return out


def at_path(json: str | Column, *path: str) -> Column:
    """The text at a path of a JSON text; null where any part is missing or no object."""
    return F.get_json_object(F.col(json) if isinstance(json, str) else json, "$" + "".join(f"['{p}']" for p in path))


def by_created(issues: DataFrame) -> DataFrame:
    """Raw issues in order of creation, then number."""
    return issues.orderBy("createdAt", "number")


def snapshot_files(spark: SparkSession, folder: str, extensions: tuple[str, ...]) -> DataFrame:
    """Source files of a snapshot as ``file_path, text``, those of the extensions only; bytes that are no UTF-8 are replaced."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = folder.rstrip("/") + "/"  # what stands behind its first occurrence in the path
    path = F.expr(f"substring(path, locate({json.dumps(base)}, path) + {len(base)})")
    kept = F.lower(F.regexp_extract(F.col("path"), r"\.([^./]+)$", 1)).isin(*extensions)
    return b.where(kept).select(path.alias("file_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_stage(df: DataFrame, folder: str, name: str, partition: tuple[str, ...] = ()) -> str:
    """A stage table as parquet, replaced as a whole; its path."""
    path = os.path.join(folder, name)
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with the fields in order of name."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def manifest(df: DataFrame, **settings: str) -> DataFrame:
    """One row: the number of rows and the settings they were made with."""
    return df.agg(F.count("*").alias("row_count")).select("row_count", *[F.lit(v).alias(k) for k, v in sorted(settings.items())])


def save_page(spark: SparkSession, text: str, path: str) -> None:
    """A small text (a page) as one file, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
