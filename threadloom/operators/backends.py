"""The edges where a model is called. The call is injected; nothing here reaches out by itself."""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions import vocab as V
from threadloom.functions import exprs as X
from threadloom.operators import extract, prompting

Completion = Callable[[str], str]


def complete(prompts: DataFrame, make: Callable[[], Completion], column: str = "prompt") -> DataFrame:
    """Prompts with ``response``, ``error_type`` and ``error_message``; a failed call becomes a row, not a failed job.

    `make` builds the completion once per task, on the worker.
    """
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema)}, response string, error_type string, error_message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()

        def one(text):
            try:
                return call(text), None, None
            except Exception as e:  # noqa: BLE001 - the error is the result
                return None, type(e).__name__, str(e)

        for batch in batches:
            done = [one(t) for t in batch[column]]
            yield batch.assign(**{c: pd.Series([d[k] for d in done], index=batch.index, dtype=object) for k, c in enumerate(("response", "error_type", "error_message"))})

    return prompts.mapInPandas(run, schema)


def embed(texts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], key: str, text: str, batch: int = 16) -> DataFrame:
    """``key, embedding``: vectors of length 1, worked out `batch` texts at a time; null texts are empty, a zero vector stays.

    `make` builds the encoder once per task, on the worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for part in batches:
            said, vectors = part[text].fillna("").tolist(), []
            for lo in range(0, len(said), batch):
                for v in encode(said[lo : lo + batch]):
                    size = sum(x * x for x in v) ** 0.5 or 1.0
                    vectors.append([x / size for x in v])
            yield pd.DataFrame({key: part[key], "embedding": vectors})

    return texts.select(key, text).mapInPandas(run, f"`{key}` {texts.schema[key].dataType.simpleString()}, embedding array<float>")


def parse_artifacts(text: str | None) -> tuple[list[dict], str | None]:
    """Artifacts of a model's JSON answer, and what is wrong with it; those of an unknown type or without a summary drop out."""
    try:
        parsed = json.loads(text or "")
    except ValueError as e:
        return [], str(e)
    items = parsed.get("artifacts") if isinstance(parsed, dict) else None
    if not isinstance(items, list):
        return [], "no artifacts"
    return [a for a in items if isinstance(a, dict) and a.get("type") in V.METADATA_FIELDS and str(a.get("summary") or "").strip()], None


def metadata_text(value) -> str:
    """A metadata value as text: null is empty, lists join by blanks, objects as sorted ``k: v`` by semicolons, booleans as True and False."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value.strip()
    if isinstance(value, list | tuple):
        return " ".join(t for v in value if (t := metadata_text(v)))
    if isinstance(value, dict):
        return " ; ".join(f"{k}: {t}" for k, v in sorted(value.items(), key=lambda kv: str(kv[0])) if (t := metadata_text(v)))
    return str(value)


# ---------------------------------------------------------------- whole runs

#: An artifact as a model's answer is parsed to: metadata values as text, whatever they were.
PARSED = "struct<artifacts: array<struct<type: string, summary: string, tags: array<string>, metadata: map<string,string>>>, problem: string>"


def parsed(responses: pd.Series) -> pd.DataFrame:
    """Answers as structs of `PARSED`."""
    out = []
    for text in responses:
        found, problem = parse_artifacts(text)
        shaped = []
        for a in found:
            tags, metadata = a.get("tags"), a.get("metadata")
            shaped.append({"type": a["type"], "summary": str(a["summary"]), "tags": [t for t in tags if isinstance(t, str)] if isinstance(tags, list) else [], "metadata": {str(k): metadata_text(v) for k, v in metadata.items()} if isinstance(metadata, dict) else {}})
        out.append((shaped, problem))
    return pd.DataFrame(out, columns=["artifacts", "problem"])


def model_artifacts(jobs: DataFrame, make: Callable[[], Completion]) -> DataFrame:
    """Comments through a model: the columns of jobs without the text, status, error_type, error_message, artifact_idx, type, summary,
    tags, metadata.

    jobs: repository, issue_number, author, link, text and any keys. A comment whose call fails or whose answer isn't of the wanted shape
    is one row with status ``error``; one without artifacts one row with status ``ok`` and nulls. Tags and metadata are put into shape
    as `extract.normal_artifacts` does.
    """
    keys = [c for c in jobs.columns if c not in ("author", "association", "link", "text")]
    answered = complete(jobs.select(*keys, prompting.comment_prompt().alias("prompt")), make).drop("prompt")
    read = answered.withColumn("p", F.pandas_udf(parsed, PARSED)("response"))
    failed = F.col("error_type").isNotNull() | F.col("p.problem").isNotNull()
    each = read.select(
        *keys,
        F.when(failed, "error").otherwise("ok").alias("status"),
        F.coalesce("error_type", F.when(F.col("p.problem").isNotNull(), "ValidationError")).alias("error_type"),
        F.coalesce("error_message", "p.problem").alias("error_message"),
        F.posexplode_outer(F.when(~failed, F.col("p.artifacts"))).alias("artifact_idx", "a"),
    )
    flat = each.select(*keys, "status", "error_type", "error_message", "artifact_idx", "a.type", "a.summary", F.array_distinct(F.transform(F.coalesce("a.tags", F.array().cast("array<string>")), X.snake)).alias("tags"), "a.metadata")
    none = flat.where("type is null")
    return extract.normal_artifacts(flat.where("type is not null")).select(flat.columns).unionByName(none.withColumn("tags", F.lit(None).cast("array<string>")))


def derived_artifacts(responses: DataFrame, make: Callable[[], Completion]) -> DataFrame:
    """Artifacts of the comments in a model's answers (repository, issue_number, model_id, response), kept under the answering model."""
    said = responses.where("response is not null").select("repository", "issue_number", "model_id", F.posexplode(prompting.split_response("response")).alias("comment_idx", "text"))
    return model_artifacts(said.withColumns({"author": F.col("model_id"), "link": F.lit("")}), make)


def answers(prompts: DataFrame, make: Callable[[], Completion], model_id: str) -> DataFrame:
    """Prompts with response, error_type, error_message and the model; prompts that are too long (null) stay without an answer."""
    ready = complete(prompts.where("prompt is not null"), make)
    left = prompts.where("prompt is null").withColumns({"response": F.lit(None).cast("string"), "error_type": F.lit("PromptTooLong"), "error_message": F.lit(None).cast("string")})
    return ready.unionByName(left).withColumn("model_id", F.lit(model_id))


def run_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """Per keys: total_comments, failed_comments, artifact_count of rows as `model_artifacts` gives them."""
    comment = rows.groupBy(*keys, "comment_idx").agg(F.max((F.col("status") == "error").cast("int")).alias("failed"), F.count("type").alias("n"))
    return comment.groupBy(*keys).agg(F.count("*").alias("total_comments"), F.sum("failed").alias("failed_comments"), F.sum("n").alias("artifact_count"))


def stub() -> Completion:
    """A completion that needs no model: comments that ask are questions, others reports; issues get an answer made of their own title."""

    def call(prompt: str) -> str:
        said = re.search(r"^Comment JSON:\n(.*)$", prompt, re.MULTILINE)
        if said:
            text = json.loads(said[1])["text"]
            short = re.sub("[ \t\r\n]+", " ", text).strip(" ")[:60].strip(" ")
            kind = "question" if "?" in text else "status_update"
            return json.dumps({"artifacts": [{"type": kind, "summary": short, "tags": [], "metadata": {}}] if short else []})
        title = re.search(r"^Issue #?\S*:? ?(.*)$", prompt, re.MULTILINE)
        return f"[Question] Is this still open?\n[Status] {title[1] if title else 'seen'}"

    return call


def runner(name: str = "stub") -> Callable[[], Completion]:
    """The maker of a completion: the built-in stub, or ``module:function`` of the caller's own."""
    if name == "stub":
        return stub
    module, _, function = name.partition(":")
    if not function:
        raise ValueError("a completion is named module:function")
    return getattr(importlib.import_module(module), function)
