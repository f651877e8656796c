"""Typed artifacts from comments by keyword rules; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.functions import vocab as V

FENCE = r"(?s)```[^\n`]*\n.*?```"


def _has(text: Column, words: str) -> Column:
    return text.rlike("(?i)(?U)" + words)


def tags(text: Column) -> Column:
    """Tags whose text occurs anywhere, in the order of the rules, then ``bug``; ``incorrect_behavior`` if there is none."""
    allowed = set(V.ALLOWED_TAGS)

    def of(low: Column) -> Column:
        hits = [F.when(low.contains(n), F.lit(t)) for n, t in V.TAG_RULES if t in allowed] + [F.when(low.contains("bug"), F.lit("bug"))]
        return F.array_distinct(F.array_compact(F.array(*hits)))

    return X.let(X.let(F.lower(text), of), lambda found: F.when(F.size(found) == 0, F.array(F.lit("incorrect_behavior"))).otherwise(found))


def metadata(kind: str, **given: Column | str) -> Column:
    """The fields of a type as a map; what isn't given, is null or empty is ``unknown``."""
    value = lambda f: F.lit(given[f]) if isinstance(given.get(f), str) else given.get(f, F.lit("unknown"))
    return F.create_map(*[x for f in V.METADATA_FIELDS[kind] for x in (F.lit(f), F.coalesce(F.nullif(value(f), F.lit("")), F.lit("unknown")))])


def _artifact(kind: str, summary: Column, found: Column, **given) -> Column:
    """An artifact; summary is a cleaned one, empty if nothing is left of it."""
    return F.struct(F.lit(kind).alias("type"), _or(summary, kind.replace("_", " ")).alias("summary"), found.alias("tags"), metadata(kind, **given).alias("metadata"))


def _or(x: Column, other: str) -> Column:
    return F.when(x != "", x).otherwise(F.lit(other))


def code_blocks(text: Column) -> Column:
    """A code_snippet for each fenced block that holds something."""

    def one(block: Column) -> Column:
        language = X.strip(F.regexp_extract(block, r"^```([^\n`]*)\n", 1))
        body = X.strip(F.regexp_extract(block, r"(?s)^```[^\n`]*\n(.*)```$", 1))
        return X.let(body, lambda body: F.when(body != "", _artifact("code_snippet", X.clean_summary(F.concat(F.lit("Code block showing "), X.first_sentence(body)), ""), tags(block), language=_or(language, "plaintext"), snippet_kind=F.when(F.lower(body).contains("error"), "log").otherwise("example"), intended_use="illustration")))

    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), one))


def with_artifacts(df: DataFrame, text: str = "text", into: str = "artifacts") -> DataFrame:
    """The artifacts of one comment, in order, without those that repeat an earlier type and summary; none for a blank or null one.

    What several rules need is worked out once, in columns of its own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumns({"__first": X.first_sentence(t), "__lines": X.lines(t), "__tags": tags(t), "__low": F.lower(t), "__blocks": code_blocks(t)})
    df = df.withColumn("__asked", F.filter("__lines", lambda s: s.endswith("?") & (F.char_length(s) <= 220) & ~s.startswith("###")))
    cleaned = {"__sum": X.clean_summary("__first", ""), "__ask": X.clean_summary(F.coalesce(F.get("__asked", F.lit(0)), F.col("__first")), ""), "__line": X.clean_summary(F.coalesce(F.get("__lines", F.lit(0)), F.lit("")), "")}
    df = df.withColumns(cleaned)
    first, asked, low, found, summary = (F.col(c) for c in ("__first", "__asked", "__low", "__tags", "__sum"))
    rules = [
        F.when((F.size(asked) > 0) | first.rlike("(?i)(?U)" + V.QUESTION_START), _artifact("question", F.col("__ask"), found, question_kind="clarification_request")),
        F.when(_has(t, V.SOLUTION_WORDS), _artifact("proposed_solution", summary, found, solution_kind="code_change")),
        F.when(_has(first, V.SUGGESTION_WORDS), _artifact("suggestion", summary, found)),
        F.when(
            _has(t, V.STATUS_WORDS),
            _artifact(
                "status_update", summary, found, status_kind=F.when(low.contains("release") | low.contains("rc"), "released").otherwise("update"),
                progress_state=F.when(_has(t, V.DONE_WORDS), "complete").otherwise("in_progress"), blocking=F.when(_has(t, V.BLOCK_WORDS), "True").otherwise("False"),
            ),
        ),
        F.when(_has(t, V.TASK_WORDS), _artifact("task_assignment", summary, found, assignee=F.regexp_extract(t, r"(?U)@[\w-]+", 0))),
        F.when(_has(first, V.PRIORITY_WORDS), _artifact("priority_discussion", summary, found, scope="release_planning")),
        F.when(_has(t, V.PROBLEM_WORDS), _artifact("problem_statement", summary, found, problem_kind="bug_report")),
    ]
    df = df.withColumn("__ruled", F.array(*rules))
    key = lambda a: F.struct(a["type"], a["summary"])
    df = df.withColumn("__found", F.concat("__blocks", F.array_compact("__ruled")))
    df = df.withColumn("__keys", F.transform("__found", key))
    fallback = F.array(_artifact("status_update", F.col("__line"), found, status_kind="mention", progress_state="informative", blocking="False"))
    distinct = F.filter("__found", lambda a, i: F.array_position(F.col("__keys"), key(a)) == i + 1)
    df = df.withColumn(into, F.when(F.size("__lines") <= 0, F.slice("__found", 1, 0)).when(F.size("__found") > 0, distinct).otherwise(fallback))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def comments(curated: DataFrame, issue_body: bool = False) -> DataFrame:
    """One row per post of the thread: the record's keys, comment_idx, author, association, link, text; blank posts stay."""
    keys = [c for c in ("record_id", "snapshot_id", "repository", "issue_number") if c in curated.columns]
    e = curated.select(*keys, F.posexplode("deliberation_thread").alias("comment_idx", "c")).where("c is not null")
    if not issue_body:
        e = e.where(~F.coalesce("c.is_issue_body", F.lit(False)))
    return e.select(*keys, "comment_idx", F.coalesce("c.author_login", F.lit("")).alias("author"), F.col("c.author_association").alias("association"), F.coalesce("c.url", F.lit("")).alias("link"), F.coalesce("c.body", F.lit("")).alias("text"))


def extract(curated: DataFrame, issue_body: bool = False) -> DataFrame:
    """One row per artifact of each comment: keys, comment_idx, artifact_idx, type, summary, tags, metadata."""
    c = comments(curated, issue_body)
    keys = [x for x in c.columns if x not in ("author", "association", "link", "text")]
    return with_artifacts(c).select(*keys, F.posexplode("artifacts").alias("artifact_idx", "a")).select(*keys, "artifact_idx", "a.type", "a.summary", "a.tags", "a.metadata")


def run_totals(curated: DataFrame) -> DataFrame:
    """One row: issues, comments, comments with artifacts, artifacts."""
    c = with_artifacts(comments(curated)).select("issue_number", "repository", F.size("artifacts").alias("n"))
    return c.agg(F.count_distinct("repository", "issue_number").alias("issues"), F.count("*").alias("comments"), F.count_if(F.col("n") > 0).alias("comments_with_artifacts"), F.sum("n").alias("artifacts"))


def normal_artifacts(artifact: DataFrame) -> DataFrame:
    """Model output put into shape: allowed tags only (else ``incorrect_behavior``), the type's metadata fields with ``unknown`` for what is missing."""
    allowed = F.filter(F.col("tags"), lambda t: t.isin(*V.ALLOWED_TAGS))
    fields = F.create_map(*[x for k, fs in V.METADATA_FIELDS.items() for x in (F.lit(k), F.array(*map(F.lit, fs)))])
    shaped = F.map_from_arrays(F.col("fields"), F.transform("fields", lambda f: F.coalesce(F.when(F.col("metadata")[f] != "", F.col("metadata")[f]), F.lit("unknown"))))
    a = artifact.where(F.col("type").isin(*V.ARTIFACT_TYPES)).withColumn("fields", fields[F.col("type")])
    return a.withColumns({"tags": F.when(F.size(allowed) > 0, allowed).otherwise(F.array(F.lit("incorrect_behavior"))), "metadata": shaped}).drop("fields")
