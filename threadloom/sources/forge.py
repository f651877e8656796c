"""A paged issue service as a Spark data source: ``spark.read.format("issue_forge")``.

Options: ``repositories`` (comma-separated), ``states``, ``min_comments``, ``max_comments``, ``max_issues``, ``page_size``,
``max_retries``. The transport is a function ``(query, variables) -> payload`` that the caller registers; there is none by
default and nothing is fetched. One partition per repository.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Transport = Callable[[str, dict], dict]


class ForgeError(RuntimeError):
    """The service answered with errors."""


def execute(transport: Transport, query: str, variables: dict, max_retries: int = 4, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The answer's data. Transport failures are tried again after 1, 2, 4, ... seconds; errors in the answer are raised at once."""
    for attempt in range(max_retries + 1):
        try:
            answer = transport(query, variables)
            break
        except (OSError, TimeoutError):
            if attempt == max_retries:
                raise
            sleep(2**attempt)
    if answer.get("errors"):
        raise ForgeError(str(answer["errors"]))
    return answer["data"]


def issue_numbers(transport: Transport, repository: str, states: tuple[str, ...] = ("OPEN", "CLOSED"), least: int = 0, most: int | None = None, limit: int | None = None, page: int = 25, **how) -> Iterator[int]:
    """Numbers of issues with least to most comments, newest first, page by page until `limit` are found."""
    after, found = None, 0
    while limit is None or found < limit:
        issues = execute(transport, "issues", {"repository": repository, "states": list(states), "first": page, "after": after}, **how)["repository"]["issues"]
        for node in issues["nodes"]:
            n = node["comments"]["totalCount"]
            if n >= least and (most is None or n <= most):
                yield node["number"]
                found += 1
                if limit is not None and found >= limit:
                    return
        if not issues["pageInfo"]["hasNextPage"]:
            return
        after = issues["pageInfo"]["endCursor"]


def fetch_issue(transport: Transport, repository: str, number: int, page: int = 100, **how) -> dict:
    """The whole issue; comments and timeline items of all pages, each once."""
    cursors: dict[str, str | None] = {"comments": None, "timelineItems": None}
    open_, issue = set(cursors), None
    seen: dict[str, dict] = {"comments": {}, "timelineItems": {}}
    while open_:
        got = execute(transport, "issue", {"repository": repository, "number": number, "first": page, **{"after_" + k: v for k, v in cursors.items()}}, **how)["repository"]["issue"]
        issue = issue or got
        for k in list(open_):
            for node in got[k]["nodes"]:
                if node is not None:
                    key = node.get("id") if k == "comments" else (node.get("__typename"), node.get("createdAt"), json.dumps(node, sort_keys=True))
                    seen[k].setdefault(key, node)
            cursors[k] = got[k]["pageInfo"]["endCursor"]
            if not got[k]["pageInfo"]["hasNextPage"]:
                open_.discard(k)
    labels = issue.get("labels")
    return {**issue, "labels": labels["nodes"] if isinstance(labels, dict) else labels, **{k: list(v.values()) for k, v in seen.items()}}


def register(spark: SparkSession, transport: Transport, name: str = "issue_forge") -> None:
    """Make the source known under a name; rows are ``repository, number, payload`` with the payload as JSON."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.options = options

        def partitions(self):
            return [InputPartition(r.strip()) for r in self.options.get("repositories", "").split(",") if r.strip()]

        def read(self, partition):
            o, whole = self.options, lambda k: int(self.options[k]) if self.options.get(k) else None
            how = {"max_retries": int(o.get("max_retries", 4))}
            states = tuple(s for s in o.get("states", "OPEN,CLOSED").split(",") if s)
            for n in issue_numbers(transport, partition.value, states, int(o.get("min_comments", 0)), whole("max_comments"), whole("max_issues"), int(o.get("page_size", 25)), **how):
                yield partition.value, n, json.dumps(fetch_issue(transport, partition.value, n, **how), sort_keys=True)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "repository string, number bigint, payload string"

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)
