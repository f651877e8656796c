"""Raw issues to curated records.

Everything is one projection per issue, built on array functions: no shuffle, no Python. Null arrays are empty, null elements
drop out, sorts are stable by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.functions import vocab as V

PATH = r"(?U)(?<!://)\b(?:[\w.-]+/)+[\w.-]+\.[A-Za-z_][A-Za-z0-9_+-]*\b"  # a fixed value: what looks like a path
NAME = rf"(?U)(?<!\.)\b[\w-]+\.(?:{V.FILE_EXTENSIONS})\b"  # a fixed value: what looks like a file
EDGE = r"^[`'\"()\[\]{}<>.,:;]+|[`'\"()\[\]{}<>.,:;]+$"


def by_time(x: str | Column) -> Column:
    """Elements in order of createdAt, equal ones and those without in their old order, the latter first."""
    keyed = F.transform(F.array_compact(X.col(x)), lambda e, i: F.struct(F.coalesce(e["createdAt"], F.lit("")).alias("t"), i.alias("i"), e.alias("e")))
    return F.transform(F.array_sort(keyed), lambda k: k["e"])


def once(x: str | Column, key) -> Column:
    """Elements whose key isn't that of an earlier one; those of a null key all stay."""
    a = F.array_compact(X.col(x))
    keys = F.transform(a, key)
    return F.filter(a, lambda e, i: key(e).isNull() | (F.array_position(keys, key(e)) == i + 1))


def login(x: Column) -> Column:
    """The login of an account that has one, as it stands."""
    return X.blank_null(x["login"])


def opening_text(title: str | Column, body: str | Column) -> Column:
    """Title and body, stripped, with a blank line between; the one that there is; else an empty text."""
    t, b = (F.coalesce(X.strip(x), F.lit("")) for x in (title, body))
    return F.when((t != "") & (b != ""), F.concat(t, F.lit("\n\n"), b)).otherwise(F.concat(t, b))


def role(association: Column) -> Column:
    """The displayed role of an author association."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in V.ROLES.items() for x in pair])[association], F.lit("external"))


def _post(url, created, who, association, body, opening: bool) -> Column:
    return F.struct(url.alias("url"), created.alias("created_at"), who.alias("author_login"), association.alias("author_association"), body.alias("body"), F.lit(opening).alias("is_issue_body"))


def thread() -> Column:
    """The opening post, if it has a text, and the comments by time."""
    text = opening_text("title", "body")
    first = _post(F.col("url"), F.col("createdAt"), login(F.col("author")), F.col("authorAssociation"), text, True)
    rest = F.transform("__comments", lambda c: _post(c["url"], c["createdAt"], login(c["author"]), c["authorAssociation"], F.coalesce(c["body"], F.lit("")), False))
    return F.concat(F.when(text != "", F.array(first)).otherwise(F.slice(F.array(first), 1, 0)), rest)


def discussion(posts: str | Column) -> Column:
    """``login (role):text`` lines of the posts that hold a text."""
    said = F.filter(X.col(posts), lambda p: X.squash(p["body"]) != "")
    line = lambda p: F.concat(F.when(p["author_login"] != "", p["author_login"]).otherwise(F.lit("unknown")), F.lit(" ("), role(p["author_association"]), F.lit("):"), X.squash(p["body"]))
    return F.array_join(F.transform(said, line), "\n")


def files(texts: Column) -> Column:
    """Paths and file names in the texts, each once, in order; a name that ends a path found before isn't listed again."""
    clean = lambda a: F.filter(F.transform(a, lambda m: F.regexp_replace(m, EDGE, "")), lambda m: m != "")
    found = lambda t, p: clean(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    ends = lambda s, n: F.exists(s, lambda p: p.endswith(F.concat(F.lit("/"), n)))
    one = lambda s, n: F.when(ends(s, n) | F.array_contains(s, n), s).otherwise(F.array_append(s, n))
    return F.aggregate(texts, F.array().cast("array<string>"), lambda s, t: F.aggregate(found(t, NAME), F.array_distinct(F.concat(s, found(t, PATH))), one))


def _source(s: Column) -> Column:
    names = (("__typename", "type"), ("number", "number"), ("url", "url"), ("title", "title"), ("state", "state"), ("merged", "merged"), ("mergedAt", "merged_at"))
    return F.struct(*[s[a].alias(b) for a, b in names])


def events() -> Column:
    """Timeline items by time, with what their kind has."""

    def event(e: Column) -> Column:
        kind = e["__typename"]
        crossed = kind == "CrossReferencedEvent"
        return F.struct(
            kind.alias("event_type"),
            e["createdAt"].alias("created_at"),
            login(e["actor"]).alias("actor_login"),
            F.when(kind.isin("LabeledEvent", "UnlabeledEvent"), e["label"]["name"]).alias("label_name"),
            F.when(kind == "ClosedEvent", e["stateReason"]).alias("state_reason"),
            F.when(crossed, F.coalesce(e["willCloseTarget"], F.lit(False))).alias("will_close_target"),
            F.when(crossed, _source(e["source"])).alias("source"),
        )

    return F.transform("__items", event)


def pull_requests() -> Column:
    """Pull requests that refer to the issue, by time."""
    crossed = F.filter("__items", lambda e: F.coalesce((e["__typename"] == "CrossReferencedEvent") & (e["source"]["__typename"] == "PullRequest"), F.lit(False)))
    of = lambda e: F.struct(*[e["source"][a].alias(b) for a, b in (("number", "number"), ("url", "url"), ("title", "title"), ("state", "state"), ("merged", "merged"), ("mergedAt", "merged_at"))], F.coalesce(e["willCloseTarget"], F.lit(False)).alias("will_close_target"), e["createdAt"].alias("referenced_at"))
    return F.transform(crossed, of)


def labels() -> Column:
    """Names of labels, each once, sorted."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform("labels", lambda x: x["name"]), lambda n: n != ""))), F.array().cast("array<string>"))


def curate(raw: DataFrame, distinct: bool = False) -> DataFrame:
    """One curated record per raw issue; the columns of raw that the record doesn't name are left out but for snapshot_id.

    distinct: first drop comments of an id met before and timeline items equal to an earlier one, as a fetch over pages does.
    """
    raw = raw.withColumns({c: F.coalesce(c, F.array().cast(raw.schema[c].dataType)) for c in ("comments", "timelineItems")})
    comments = once("comments", lambda c: c["id"]) if distinct else F.array_compact("comments")
    items = once("timelineItems", lambda e: F.to_json(e)) if distinct else F.array_compact("timelineItems")
    df = raw.withColumns({"__comments": by_time(comments), "__items": by_time(items)})
    df = df.withColumn("__thread", thread())
    body = F.coalesce("body", F.lit(""))
    keep = ["snapshot_id"] if "snapshot_id" in raw.columns else []
    df = df.select(
        *keep,
        "repository",
        F.col("number").alias("issue_number"),
        F.col("url").alias("issue_url"),
        files(F.filter(F.transform("__thread", lambda p: p["body"]), lambda b: b != "")).alias("files"),
        discussion("__thread").alias("formatted_discussion"),
        F.struct(login(F.col("author")).alias("login"), F.col("authorAssociation").alias("author_association")).alias("issue_author"),
        F.struct("title", body.alias("body")).alias("input_vector"),
        F.struct(labels().alias("labels"), F.col("state").alias("issue_state"), F.col("stateReason").alias("state_reason"), F.col("createdAt").alias("created_at"), F.col("closedAt").alias("closed_at")).alias("taxonomic_metadata"),
        F.col("__thread").alias("deliberation_thread"),
        events().alias("timeline_events"),
        F.struct(pull_requests().alias("linked_pull_requests"), F.col("state").alias("issue_state"), F.col("stateReason").alias("issue_state_reason"), F.col("closedAt").alias("closed_at")).alias("resolution_artifacts"),
    )
    return df


def with_comment_count(raw: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """Raw issues with least to most comments; null arrays have none."""
    n = F.coalesce(F.size(F.array_compact("comments")), F.lit(0))
    return raw.where((F.greatest(n, F.lit(0)) >= least) & (F.lit(True) if most is None else F.greatest(n, F.lit(0)) <= most))


def actor_typology(raw: DataFrame, *keys: str) -> DataFrame:
    """Per issue (keys) and login: sorted associations and roles, and the number of comments."""
    keys = keys or ("snapshot_id",)
    a = raw.select(*keys, login(F.col("author")).alias("login"), F.col("authorAssociation").alias("association"), F.lit("issue_author").alias("role"), F.lit(0).alias("n"))
    c = raw.select(*keys, F.explode(F.array_compact("comments")).alias("c")).select(*keys, login(F.col("c.author")).alias("login"), F.col("c.authorAssociation").alias("association"), F.lit("commenter").alias("role"), F.lit(1).alias("n"))
    t = raw.select(*keys, F.explode(F.array_compact("timelineItems")).alias("t")).select(*keys, login(F.col("t.actor")).alias("login"), F.lit(None).cast("string").alias("association"), F.coalesce("t.__typename", F.lit("timeline_actor")).alias("role"), F.lit(0).alias("n"))
    both = a.unionByName(c).unionByName(t).where("login is not null")
    return both.groupBy(*keys, "login").agg(F.array_sort(F.collect_set(F.when(F.col("association") != "", F.col("association")))).alias("author_associations"), F.array_sort(F.collect_set("role")).alias("roles"), F.sum("n").alias("comment_count"))


def summarize(curated: DataFrame) -> DataFrame:
    """One row of counts over curated records; the opening post counts as a comment."""
    prs = F.col("resolution_artifacts.linked_pull_requests")
    return curated.agg(
        F.count("*").alias("record_count"),
        F.count_if(F.size("deliberation_thread") > 0).alias("records_with_comments"),
        F.count_if(F.size("timeline_events") > 0).alias("records_with_timeline_events"),
        F.coalesce(F.sum(F.size(prs)), F.lit(0)).alias("linked_pull_request_count"),
        F.coalesce(F.sum(F.size(F.filter(prs, lambda p: p["merged"]))), F.lit(0)).alias("merged_linked_pull_request_count"),
    )


def state_distribution(curated: DataFrame) -> DataFrame:
    return curated.groupBy(F.col("taxonomic_metadata.issue_state").alias("issue_state")).agg(F.count("*").alias("n"))
