"""Prompts, their budgets, few-shot examples, routing, and splitting of answers. Texts are assembled by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.functions import vocab as V

# ---- fixed values: the lines of a prompt
INTRO = "\n".join(
    (
        "Read the issue and think like a human engineer.",
        "Write at least 20 short comments. Conflicting or unrelated comments are allowed.",
        "Each line must follow: [Topic] comment",
        "Use only these topics:",
        "; ".join(V.TOPICS),
    )
)
EXAMPLES_FOLLOW = "Here are examples from the same repository. Follow their format, but do not copy them:"
MARKER = r"\[[^\]\n]{1,120}\]"


def _text(x: str | Column) -> Column:
    return F.coalesce(X.strip(x), F.lit(""))


def heading(number: Column, title: Column) -> Column:
    return F.when(number.isNotNull(), F.concat(F.lit("Issue #"), number.cast("string"), F.lit(": "), _text(title))).otherwise(F.concat(F.lit("Issue: "), _text(title)))


def block(c: Column) -> Column:
    """A chunk as ``[path:first-last (symbol)]`` and its text; null if the text is blank."""
    where = F.concat(F.coalesce(F.when(c["file_path"] != "", c["file_path"]), F.lit("unknown")), F.coalesce(F.concat(F.lit(":"), c["start_line"].cast("string"), F.lit("-"), c["end_line"].cast("string")), F.lit("")))
    symbol = F.coalesce(F.when(X.strip(c["symbol_name"]) != "", F.concat(F.lit(" ("), X.strip(c["symbol_name"]), F.lit(")"))), F.lit(""))
    return F.when(_text(c["text"]) != "", F.concat(F.lit("["), where, symbol, F.lit("]\n"), _text(c["text"])))


def example(e: Column, n: Column) -> Column:
    """A worked example; null if its response is blank."""
    body = F.when(_text(e["body"]) != "", F.concat(_text(e["body"]), F.lit("\n"))).otherwise(F.lit(""))
    return F.when(_text(e["response"]) != "", F.concat(F.lit("Example "), (n + 1).cast("string"), F.lit("\n"), heading(e["issue_number"], e["title"]), F.lit("\n"), body, F.lit("Response:\n"), _text(e["response"])))


def prompt(number: Column, title: Column, body: Column, context: Column | None, examples: Column | None = None) -> Column:
    """The prompt for an issue; context None means left out by setting, an empty array that there is none."""
    parts = [F.lit(INTRO)]
    if examples is not None:
        shown = F.array_compact(F.transform(examples, example))
        parts.append(F.when(F.size(shown) > 0, F.concat(F.lit("\n" + EXAMPLES_FOLLOW + "\n"), F.array_join(shown, "\n\n"))))
    parts += [F.concat(F.lit("\n"), heading(number, title)), _text(body)]
    if context is None:
        parts.append(F.lit("\nCode context omitted by configuration."))
    else:
        shown = F.array_compact(F.transform(context, block))
        parts.append(F.when(F.size(shown) > 0, F.concat(F.lit("\nCode context:\n"), F.array_join(shown, "\n\n"))).otherwise(F.lit("\nCode context: [none]")))
    return F.concat(F.regexp_replace(F.concat_ws("\n", *parts), r"(?U)^\s+|\s+$", ""), F.lit("\n"))


def prompts_within(issues: DataFrame, chunks: DataFrame, keys: list[str], max_chars: int = 32_768, max_chunks: int = 10, order: str = "chunk_id") -> DataFrame:
    """keys, prompt, context_chunks: the shortest chunks that keep each issue's prompt within max_chars.

    issues: keys, number, title, body. chunks: keys, chunk_id, file_path, symbol_name, start_line, end_line, text; blank ones
    take a place but aren't shown; ties of length go by `order`. Only the max_chunks shortest of an issue can be used and only those are gathered.
    """
    over = Window.partitionBy(*keys).orderBy(F.char_length("text"), order)
    few = chunks.where("text is not null and text <> ''").withColumn("place", F.row_number().over(over)).where(F.col("place") <= max_chunks)
    item = F.struct("place", "chunk_id", "file_path", "symbol_name", "start_line", "end_line", "text")
    got = few.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("chunks"))
    j = issues.join(got, keys, "left").withColumn("chunks", F.coalesce("chunks", F.slice("chunks", 1, 0), F.from_json(F.lit("[]"), got.schema["chunks"].dataType)))
    number, title, body = F.col("number"), F.col("title"), F.col("body")
    base = prompt(number, title, body, None)
    shown = F.transform("chunks", lambda c: block(c))
    # length of the prompt with the first n chunks: what stands before them, the blocks, and two line ends between blocks
    before = F.char_length(F.concat_ws("\n", F.lit(INTRO), F.concat(F.lit("\n"), heading(number, title)), _text(body), F.lit("\nCode context:\n"))) + 1
    sizes = F.transform("shown", lambda s: F.coalesce(F.char_length(s) + 2, F.lit(0)))
    total = F.transform(F.sequence(F.lit(0), F.size("shown")), lambda n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x) - F.when(F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x) > 0, 2).otherwise(0))
    fits = F.size(F.filter("total", lambda t: F.col("before") + t <= max_chars)) - 1
    j = j.withColumn("shown", shown).withColumns({"base": base, "before": before, "total": total})
    j = j.withColumn("used", F.slice("chunks", F.lit(1), F.greatest(fits, F.lit(0))))
    full = prompt(number, title, body, F.col("used"))
    keep = (F.char_length("base") <= max_chars) & (F.char_length(full) <= max_chars)
    return j.select(*keys, F.when(keep, full).otherwise(F.col("base")).alias("prompt"), F.when(keep, F.size("used")).otherwise(0).alias("context_chunks"))


def comment_prompt(c: str = "") -> Column:
    """The request for one comment (columns repository, issue_number, author, link, text): where it stands, the comment as JSON, and
    the metadata keys of each type."""
    rules = "\n".join(["Metadata keys by type (use exact keys; never null; use 'unknown' when needed):", *(f"- {k}: {', '.join(f)}" for k, f in V.METADATA_FIELDS.items())])
    said = F.to_json(F.struct(*[F.coalesce(F.col(c + x), F.lit("")).alias(x) for x in ("author", "link", "text")]))
    return F.concat_ws("\n", F.concat(F.lit("Repo: "), F.col(c + "repository")), F.concat(F.lit("Issue: "), F.col(c + "issue_number").cast("string")), F.lit("Comment JSON:"), said, F.lit(rules))


def topic_of(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for k in V.ARTIFACT_TYPES for x in (k, V.topic(k))])[kind]


def example_responses(artifacts: DataFrame, keys: list[str], order: list[str], k: int = 5) -> DataFrame:
    """keys, response: lines ``[Topic] summary`` of the first k artifacts of each issue that have a known type and a summary."""
    known = artifacts.withColumn("topic", topic_of(F.col("type"))).where((F.col("topic").isNotNull()) & (X.strip("summary") != ""))
    first = known.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= k)
    line = F.concat(F.lit("["), F.col("topic"), F.lit("] "), X.truncate("summary", 220))
    return first.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("response"))


def split_response(text: str | Column) -> Column:
    """Comments of an answer: from each ``[Topic]`` marker to the next, text before the first is dropped; all of it if there is none."""
    t = _text(text)
    pieces = F.filter(F.transform(F.split(t, rf"(?={MARKER})"), X.strip), lambda s: s != "")
    marked = F.filter(pieces, lambda s: s.rlike("^" + MARKER))
    return F.when(t == "", F.slice(pieces, 1, 0)).when(F.size(marked) > 0, marked).otherwise(F.array(t))


def provider(model_id: str | Column) -> Column:
    """Struct of provider (``api`` or ``ollama``) and model name: by prefix, else by the look of what follows the last colon."""
    m = X.strip(model_id)
    low, tail = F.lower(m), F.lower(F.substring_index(m, ":", -1))
    answer = lambda who, name: F.struct(F.lit(who).alias("provider"), name.alias("model"))
    local = (tail.rlike(r"^\d+(\.\d+)?[bm]([-_].*)?$") | tail.rlike("[bm]$") | (tail == "latest")) & ~tail.rlike(r"^\d+$")
    return (
        F.when(low.startswith("api/"), answer("api", F.substring(m, 5, 1 << 20)))
        .when(low.startswith("openai/"), answer("api", F.substring(m, 8, 1 << 20)))
        .when(low.startswith("ollama/"), answer("ollama", F.substring(m, 8, 1 << 20)))
        .when(m.contains(":") & local, answer("ollama", m))
        .otherwise(answer("api", m))
    )


def slug(x: str | Column) -> Column:
    """A name as a folder: slashes as two underscores."""
    return F.replace(X.strip(x), F.lit("/"), F.lit("__"))


def unslug(x: str | Column) -> Column:
    """A folder as a name; not the inverse for names that hold two underscores themselves."""
    return F.replace(X.col(x), F.lit("__"), F.lit("/"))


#: Families by the word in a model's name, in the order in which boards list them; tiers of the second.
FAMILIES = (("gpt", ("gpt",)), ("claude", ("claude", "anthropic")), ("gemini", ("gemini",)), ("qwen", ("qwen",)))
TIERS = (("opus", 3.0), ("sonnet", 2.0), ("haiku", 1.0))
#: Names shown for some models.
SHOWN = {
    "gemini-2.5-flash": "Gemini 2.5 Flash",
    "gemini/gemini-3.1-flash-lite-preview": "Gemini 3.1 Flash Lite Preview",
    "us.anthropic.claude-sonnet-4-6": "Claude Sonnet 4.6",
    "us.anthropic.claude-opus-4-6-v1": "Claude Opus 4.6",
    "openai/gpt-5": "OpenAI GPT-5",
    "gpt-5.4": "OpenAI GPT-5.4",
    "gpt-4.1-mini": "OpenAI GPT-4.1 Mini",
    "qwen2.5:7b-instruct": "Qwen 2.5 7B Instruct",
}


def first_number(x: str | Column) -> Column:
    """The first number in a text, 0 if it has none."""
    return F.coalesce(F.regexp_extract(X.col(x), r"(\d+(?:\.\d*)?)", 1).try_cast("double"), F.lit(0.0))


def model_family(x: str | Column) -> Column:
    """Struct of family, recency (the first number behind the family's word; for the second family tier * 100 plus the first number),
    and rank of the family."""
    low = F.lower(X.strip(x))
    tier = F.coalesce(*[F.when(low.contains(w), F.lit(v)) for w, v in TIERS], F.lit(0.0)) * 100 + first_number(low)
    answer = lambda name, recency, rank: F.struct(F.lit(name).alias("family"), recency.alias("recency"), F.lit(rank).alias("family_rank"))
    out = answer("other", first_number(low), len(FAMILIES))
    for rank, (name, words) in reversed(list(enumerate(FAMILIES))):
        recency = tier if name == "claude" else first_number(F.regexp_extract(low, f"(?s){name}(.*)$", 1))
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, answer(name, recency, rank)).otherwise(out)
    return out


def display_name(x: str | Column) -> Column:
    """A model's name for a figure: a given one, else its words with capitals, a few of them in capitals throughout."""
    m = X.strip(x)
    words = F.filter(F.split(F.regexp_replace(m, "__|[/:-]", " "), r"(?U)\s+"), lambda w: w != "")
    shown = F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin("gpt", "llm", "api"), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))), " ")
    given = F.create_map(*[F.lit(v) for kv in SHOWN.items() for v in kv])[m]
    return F.coalesce(given, F.when(F.size(words) > 0, shown).otherwise(m))


def issue_text(raw: DataFrame, curated: DataFrame) -> DataFrame:
    """repository, issue_number, number, title, body of the latest state of each issue, as prompts show it.

    The curated title and body are preferred to the raw ones, and a non-blank opening post of the thread to the body.
    """
    key = ["repository", "issue_number"]
    r = raw.groupBy("repository", F.col("number").alias("issue_number")).agg(F.max_by(F.struct("title", "body"), F.struct("fetched_at", "snapshot_id")).alias("raw"))
    c = curated.groupBy(*key).agg(F.max_by(F.struct("input_vector", "deliberation_thread"), F.struct("ingested_at", "record_id")).alias("c"))
    opening = F.get(F.filter("c.deliberation_thread", lambda p: F.coalesce(p["is_issue_body"], F.lit(False))), F.lit(0))["body"]
    first = lambda *xs: F.coalesce(*[F.when(x != "", x) for x in xs], F.lit(""))
    title, body = first(F.col("c.input_vector.title"), F.col("raw.title")), first(F.col("c.input_vector.body"), F.col("raw.body"))
    return r.join(c, key, "left").select(*key, F.col("issue_number").alias("number"), X.strip(title).alias("title"), F.coalesce(X.blank_null(X.strip(opening)), X.strip(body)).alias("body"))


def limited(issues: DataFrame, order: list[str], number: int | None = None, limit: int | None = None) -> DataFrame:
    """Issues of one number, or all; then the first of each repository in the given order. The filter comes before the limit."""
    some = issues if number is None else issues.where(F.col("issue_number") == number)
    if limit is None:
        return some
    over = Window.partitionBy("repository").orderBy(*order)
    return some.withColumn("_n", F.row_number().over(over)).where(F.col("_n") <= limit).drop("_n")


def model_recency(x: str | Column) -> Column:
    """The first number in a model's name, 0 if it has none."""
    return first_number(x)
