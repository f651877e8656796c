"""Queries on curation, extraction, retrieval, prompting and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.functions import vocab as V
from threadloom.operators import align, backends, code_chunks, compare, curate, extract, prompting, reports, retrieve, tag_metrics, type_metrics
from threadloom.plans.metric_queries import ART, FLAGS, TAGS, _harm, _name, _ratio, _raw_scores, rounded, tag_counts, type_flags
from threadloom.session import cut, table

# ---------------------------------------------------------------- curation


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot once; rows delivered twice are identical."""
    return table(spark, d, "raw_issue").dropDuplicates(["snapshot_id"])


def _curated(spark: SparkSession, d: str) -> DataFrame:
    return curate.curate(_raw(spark, d), distinct=True)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "curated").dropDuplicates(["record_id"])


def formatted_discussion(spark, d):
    return _curated(spark, d).select("snapshot_id", "formatted_discussion")


def file_references(spark, d):
    return _curated(spark, d).select("snapshot_id", F.array_join("files", "|").alias("files"))


def thread_posts(spark, d):
    e = _curated(spark, d).select("snapshot_id", F.posexplode("deliberation_thread").alias("pos", "c"))
    return e.select("snapshot_id", "pos", "c.author_login", "c.author_association", "c.created_at", "c.body", "c.is_issue_body")


def timeline_events(spark, d):
    e = _curated(spark, d).select("snapshot_id", F.posexplode("timeline_events").alias("pos", "e"))
    return e.select("snapshot_id", "pos", "e.event_type", "e.created_at", "e.actor_login", "e.label_name", "e.state_reason", "e.will_close_target", F.col("e.source.number").alias("source_number"))


def linked_pull_requests(spark, d):
    e = _curated(spark, d).select("snapshot_id", F.explode("resolution_artifacts.linked_pull_requests").alias("p"))
    return e.select("snapshot_id", "p.number", "p.title", "p.state", "p.merged", "p.will_close_target", "p.referenced_at").distinct()


def label_sets(spark, d):
    return _curated(spark, d).select("snapshot_id", F.array_join("taxonomic_metadata.labels", "|").alias("labels"))


def actor_typology(spark, d):
    a = curate.actor_typology(_raw(spark, d))
    return a.select("snapshot_id", "login", F.array_join("author_associations", "|").alias("author_associations"), F.array_join("roles", "|").alias("roles"), "comment_count")


def dataset_summary(spark, d):
    return curate.summarize(curate.curate(_raw(spark, d)))


def state_distribution(spark, d):
    return curate.state_distribution(_curated(spark, d))


def comment_count_filter(spark, d):
    return curate.with_comment_count(_raw(spark, d), 10, 25).select("snapshot_id", "repository", "number")


def display_roles(spark, d):
    e = _curated(spark, d).select(F.explode("deliberation_thread").alias("c"))
    return e.groupBy(curate.role(F.col("c.author_association")).alias("role")).agg(F.count("*").alias("posts"))


def earliest_issue(spark, d):
    r = _raw(spark, d).groupBy("repository").agg(F.min("createdAt").alias("created_at"))
    return r.select("repository", F.date_format(F.to_timestamp("created_at", "yyyy-MM-dd'T'HH:mm:ssX"), "yyyy-MM-dd HH:mm:ss").alias("created_at"))


# ---------------------------------------------------------------- extraction


def rule_artifacts(spark, d):
    a = extract.extract(_records(spark, d))
    return a.select("record_id", "comment_idx", "artifact_idx", "type", "summary", F.array_join("tags", "|").alias("tags"), F.to_json("metadata").alias("metadata"))


def rule_type_counts(spark, d):
    """Comments of each type; all types, code and the fallback too."""
    a = extract.extract(_records(spark, d))
    return a.select("record_id", "comment_idx", "type").distinct().groupBy("type").agg(F.count("*").alias("comments"))


def rule_keyword_counts(spark, d):
    """The same of the seven rules that rest on keywords alone, which SQL can express."""
    a = extract.extract(_records(spark, d)).where("metadata['status_kind'] is null or metadata['status_kind'] <> 'mention'").where("type <> 'code_snippet'")
    return a.select("record_id", "comment_idx", "type").distinct().groupBy("type").agg(F.count("*").alias("comments"))


def rule_tag_inference(spark, d):
    c = extract.comments(_records(spark, d), issue_body=True)
    return c.select("record_id", "comment_idx", F.array_join(extract.tags(F.col("text")), "|").alias("tags"))


def extraction_run_totals(spark, d):
    return extract.run_totals(_records(spark, d))


def comment_jobs(spark, d):
    return extract.comments(_records(spark, d)).select("record_id", "comment_idx", "author", "link", "text")


def comment_prompts(spark, d):
    c = extract.comments(_records(spark, d))
    return c.select("record_id", "comment_idx", F.md5(prompting.comment_prompt()).alias("prompt_hash"))


def _model_artifacts(spark, d):
    c = extract.comments(_records(spark, d)).select("record_id", "repository", "issue_number", "comment_idx", "author", "link", "text")
    return backends.model_artifacts(c, backends.stub)


def model_artifacts(spark, d):
    """Every comment through a completion that needs no model: prompt, answer, parsing, artifacts in shape, errors as rows."""
    a = _model_artifacts(spark, d)
    return a.select("record_id", "comment_idx", "artifact_idx", "status", "type", "summary", F.array_join("tags", "|").alias("tags"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))).alias("metadata"))


def model_run_counts(spark, d):
    return backends.run_counts(_model_artifacts(spark, d), "repository", "issue_number")


def _answers(spark, d):
    issues = prompting.issue_text(_raw(spark, d), _records(spark, d))
    p = issues.select("repository", "issue_number", prompting.prompt(F.col("number"), F.col("title"), F.col("body"), None).alias("prompt"))
    return backends.answers(p, backends.stub, "stub")


def issue_responses(spark, d):
    """Each issue's prompt (without code) to the stub."""
    return _answers(spark, d).select("repository", "issue_number", "model_id", "response", "error_type")


def derived_artifacts(spark, d):
    """The answers cut into comments, and these through the stub again."""
    a = backends.derived_artifacts(_answers(spark, d), backends.stub)
    return a.select("repository", "issue_number", "model_id", "comment_idx", "artifact_idx", "status", "type", "summary")


def issue_texts(spark, d):
    """Title and body as prompts show them: curated before raw, the opening post before the body."""
    return prompting.issue_text(_raw(spark, d), _records(spark, d)).select("repository", "issue_number", "title", "body")


def model_names(spark, d):
    f = prompting.model_family("model_id")
    m = table(spark, d, "artifact").where("model_id is not null").select("model_id").distinct()
    return m.select("model_id", f["family"].alias("family"), f["family_rank"].alias("family_rank"), f["recency"].alias("recency"), prompting.display_name("model_id").alias("shown"))


def issue_context_hybrid(spark, d):
    """The chunks of each issue by lexical ranks and those of hashed vectors, fused."""
    issues, chunks = _issues(spark, d), _chunks(spark, d)
    v = retrieve.hashed_vectors(chunks.select(F.struct("repository", "chunk_no").alias("c"), "text"), "c", "text").select("c.*", "embedding")
    q = issues.select(F.struct("repository", "issue_number").alias("q"), F.concat_ws("\n\n", "title", "body").alias("text"))
    return rounded(retrieve.for_issues(issues, chunks, (v, retrieve.hashed_vectors(q, "q", "text").select("q.*", "embedding"))), 9)


def normal_artifacts(spark, d):
    a = extract.normal_artifacts(align.latest_artifacts(table(spark, d, "artifact"), normal=True))
    return a.select("artifact_id", "type", F.array_join(F.array_sort("tags"), "|").alias("tags"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))).alias("metadata"))


def _threads(spark, d):
    """The latest thread of each issue."""
    return _records(spark, d).groupBy("repository", "issue_number").agg(F.max_by("deliberation_thread", F.struct("ingested_at", "record_id")).alias("deliberation_thread"))


def _sides(spark, d):
    """Rules over the latest record of each issue, against the artifacts that people made of it."""
    last = _threads(spark, d)
    candidate = align.latest_artifacts(table(spark, d, "artifact")).where("side = 'human'")
    return cut(compare.side_by_side(extract.extract(last, issue_body=True), candidate, "people"))


def comparison_per_issue(spark, d):
    return rounded(compare.per_issue(_sides(spark, d)))


def comparison_macro(spark, d):
    return rounded(compare.macro(compare.per_issue(_sides(spark, d))))


def comparison_per_type(spark, d):
    return rounded(compare.per_type(_sides(spark, d)))


def comparison_overall(spark, d):
    """Rules read every comment; of people's comments the tables know those with an artifact."""
    both, key = _sides(spark, d), ["repository", "issue_number"]
    read = extract.comments(_threads(spark, d), issue_body=True).groupBy(*key).agg(F.count("*").alias("reference_comments"))
    marked = both.where("l = 1").groupBy(*key).agg(F.count_distinct("comment_idx").alias("candidate_comments"))
    return rounded(compare.overall(compare.per_issue(both), read.join(marked, key, "full_outer")))


def comparison_tag_frequency(spark, d):
    return compare.tag_frequency(_sides(spark, d))


# ---------------------------------------------------------------- retrieval


def _documents(spark, d):
    return retrieve.once(table(spark, d, "documents"), "doc_id")


def bm25_topk(spark, d, k: int = 10):
    docs = _documents(spark, d).select("doc_id", "text")
    return rounded(retrieve.bm25(docs, docs.where("doc_id % 100 = 0"), "doc_id", "doc_id", "text", k))


def dense_topk(spark, d, k: int = 10):
    v = table(spark, d, "embeddings")
    return rounded(retrieve.dense(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", k))


def hybrid_rrf(spark, d):
    """Lexical and dense ranks of the same documents, whose vectors are hashed token counts."""
    v = retrieve.hashed_vectors(_documents(spark, d), "doc_id", "text")
    asked = cut(retrieve.hashed_vectors(_documents(spark, d).where("doc_id % 100 = 0"), "doc_id", "text"))
    near = retrieve.dense(v, asked, "doc_id", "embedding", 50)
    return rounded(retrieve.fuse([bm25_topk(spark, d, 50).select("query_id", "doc", "rank"), near.select("query_id", "doc", "rank")], 60, 20), 9)


def _chunks(spark, d):
    return table(spark, d, "chunk").dropDuplicates(["chunk_no"])


def context_budget(spark, d):
    c = retrieve.shortest_context(_chunks(spark, d), ["repository"], "chunk_no", "text", 10, 2_000)
    return c.select("repository", "chunk_no", "chars", "place", "total")


def sliding_chunks(spark, d):
    w = retrieve.line_windows(_chunks(spark, d), "chunk_no", "text", 20, 5)
    return w.select("chunk_no", "start_line", "end_line", F.md5("text").alias("text_hash"))


def structural_chunks(spark, d):
    f = _chunks(spark, d).select("repository", "file_path", "text")
    return code_chunks.chunk_files(f).select("repository", "chunk_id", "symbol_name", "language", "start_line", "end_line", F.md5("text").alias("text_hash"))


# ---------------------------------------------------------------- prompts


def _issues(spark, d):
    """The latest title and body of each issue."""
    r = _records(spark, d).groupBy("repository", "issue_number").agg(F.max_by("input_vector", F.struct("ingested_at", "record_id")).alias("v"))
    return r.select("repository", "issue_number", F.col("issue_number").alias("number"), "v.title", "v.body")


def issue_context(spark, d):
    """The 20 chunks retrieved for each issue; the given tables hold no vectors of chunks or issues, so ranks are lexical."""
    return rounded(retrieve.for_issues(_issues(spark, d), _chunks(spark, d)), 9)


def issue_prompts(spark, d):
    key = ["repository", "issue_number"]
    all_chunks = _chunks(spark, d).drop("repository")
    found = issue_context(spark, d).select(*key, "chunk_no", "rank").join(all_chunks.select("chunk_no", F.char_length("text").alias("chars")), "chunk_no")
    near = retrieve.shortest_context(found, key, "rank", "text", 10, 32_768, "chars").join(all_chunks, "chunk_no")
    chunks = near.select(*key, "rank", "chunk_id", "file_path", "symbol_name", "start_line", "end_line", "text")
    p = prompting.prompts_within(_issues(spark, d), chunks, key, 8_000, 10, "rank")
    return p.select("repository", "issue_number", F.md5("prompt").alias("prompt_hash"), "context_chunks")


def _responses(spark, d):
    a = align.latest_artifacts(table(spark, d, "artifact")).where("side = 'human'")
    return prompting.example_responses(a, ["repository", "issue_number"], list(align.ORDER), 5)


def example_responses(spark, d):
    return _responses(spark, d)


def self_excluding_examples(spark, d):
    e = _responses(spark, d).select("repository", "issue_number")
    x = retrieve.exclude_self(e, e, ["issue_number"], ["issue_number"], 3)
    return x.select("repository", "issue_number", "example_no", "example_issue_number")


def response_comments(spark, d):
    r = _responses(spark, d)
    return r.select("repository", "issue_number", F.posexplode(prompting.split_response("response")).alias("pos", "comment"))


def resume_anti_join(spark, d):
    """Issues that each model still has to read: those that people annotated in its repositories, without those it has artifacts of."""
    a = align.latest_artifacts(table(spark, d, "artifact"))
    wanted = a.where("side = 'human'").select("repository", "issue_number").distinct().join(align.targets(a), "repository")
    return retrieve.pending(wanted, a.where("side = 'model'"), ["model_id", "repository", "issue_number"]).select("model_id", "repository", "issue_number")


def model_routing(spark, d):
    m = table(spark, d, "artifact").where("model_id is not null").select("model_id").distinct()
    p = prompting.provider("model_id")
    return m.select("model_id", p["provider"].alias("provider"), p["model"].alias("model"), prompting.slug("model_id").alias("folder"), prompting.model_recency("model_id").alias("recency"))


def repository_slugs(spark, d):
    r = table(spark, d, "raw_issue").select("repository").distinct()
    return r.select("repository", prompting.slug("repository").alias("folder"), prompting.unslug(prompting.slug("repository")).alias("back"))


# ---------------------------------------------------------------- reports


def dataset_stats(spark, d):
    return reports.dataset_stats(align.latest_artifacts(table(spark, d, "artifact")))


def _by_type(spark, d):
    return reports.mean_by_type(type_metrics.per_type(type_flags(spark, d)), "f1").withColumn("f1", F.round("f1", 9))


def mean_f1_by_type(spark, d):
    return rounded(_by_type(spark, d))


def top_types(spark, d):
    return rounded(reports.top_types(_by_type(spark, d), "f1").select("model_id", "type", "f1", "rank"))


def type_ring(spark, d):
    return reports.spread(_by_type(spark, d), "f1").select("model_id", "type", "place")


def tag_f1_by_type(spark, d):
    return rounded(reports.tag_f1_by_type(tag_counts(spark, d)))


def type_tag_scatter(spark, d):
    types = type_metrics.per_issue(type_flags(spark, d))
    tags = tag_metrics.pooled(tag_counts(spark, d)).where("level = 'issue'")
    return rounded(reports.scatter(reports.issue_series(types, "f1"), reports.issue_series(tags, "f1")))


def type_across_repositories(spark, d):
    return rounded(reports.across_repositories(type_metrics.per_issue(type_flags(spark, d)), ("precision", "recall", "f1", "jaccard")))


def box_stats(spark, d):
    issues = type_metrics.per_issue(type_flags(spark, d))
    return rounded(reports.box_stats(issues, "f1"))


def tag_shares(spark, d):
    return rounded(reports.tag_shares(align.latest_artifacts(table(spark, d, "artifact"))))


def viewer_rows(spark, d):
    return reports.viewer_rows(table(spark, d, "raw_issue"), align.latest_artifacts(table(spark, d, "artifact")))


QUERIES = (
    formatted_discussion, file_references, thread_posts, timeline_events, linked_pull_requests, label_sets, actor_typology, dataset_summary, state_distribution, comment_count_filter, display_roles, earliest_issue,
    rule_artifacts, rule_type_counts, rule_keyword_counts, rule_tag_inference, extraction_run_totals, comment_jobs, comment_prompts, normal_artifacts, model_artifacts, model_run_counts, derived_artifacts, issue_texts, issue_responses, comparison_per_issue, comparison_macro, comparison_per_type, comparison_overall, comparison_tag_frequency,
    bm25_topk, dense_topk, hybrid_rrf, context_budget, sliding_chunks, structural_chunks, issue_context, issue_context_hybrid, issue_prompts, example_responses, self_excluding_examples, response_comments, resume_anti_join, model_routing, model_names, repository_slugs,
    dataset_stats, mean_f1_by_type, top_types, type_ring, tag_f1_by_type, type_tag_scatter, type_across_repositories, box_stats, tag_shares, viewer_rows,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# ---------------------------------------------------------------- SQL

_STRIP, _SQUASH = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')", r"trim(regexp_replace(%s, '\s+', ' ', 'g'))"
_ROLE = "CASE %s " + " ".join(f"WHEN '{a}' THEN '{r}'" for a, r in V.ROLES.items()) + " ELSE 'external' END"
_LOGIN = rf"CASE WHEN {_STRIP % '%s'} <> '' THEN %s END"


def _login(x: str) -> str:
    return f"CASE WHEN {_STRIP % x} <> '' THEN {x} END"


RAW = f"""
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id) AS rn FROM raw_issue) WHERE rn = 1),
c0 AS (SELECT snapshot_id, unnest(comments) AS c, generate_subscripts(comments, 1) AS k FROM r),
c1 AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, c.id ORDER BY k) AS nth FROM c0 WHERE c IS NOT NULL),
o AS (SELECT snapshot_id, -1 AS k, '' AS t, {_login('author.login')} AS login, authorAssociation AS association, createdAt AS created_at,
  concat_ws(chr(10) || chr(10), nullif({_STRIP % 'title'}, ''), nullif({_STRIP % 'body'}, '')) AS body, true AS opening FROM r),
posts AS (
  SELECT * FROM o WHERE body <> ''
  UNION ALL SELECT snapshot_id, k, coalesce(c.createdAt, '') AS t, {_login('c.author.login')}, c.authorAssociation, c.createdAt, coalesce(c.body, ''), false FROM c1 WHERE c.id IS NULL OR nth = 1),
t0 AS (SELECT snapshot_id, unnest(timelineItems) AS e, generate_subscripts(timelineItems, 1) AS k FROM r),
t1 AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id, e ORDER BY k) AS nth FROM t0 WHERE e IS NOT NULL)"""

RECORDS = """
rec AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id) AS rn FROM curated) WHERE rn = 1),
post AS (SELECT record_id, unnest(deliberation_thread) AS c, generate_subscripts(deliberation_thread, 1) - 1 AS comment_idx FROM rec)"""


def _re(words: str) -> str:
    return "(?i)" + words.replace("'", "''")


_FIRST = rf"(CASE WHEN regexp_extract({_SQUASH % 'text'}, '^(.+?[.?!])(?:\s|$)', 1) <> '' THEN regexp_extract({_SQUASH % 'text'}, '^(.+?[.?!])(?:\s|$)', 1) ELSE {_SQUASH % 'text'} END)"


def _tag_sql() -> str:
    words: dict[str, list[str]] = {}
    for n, t in (*V.TAG_RULES, ("bug", "bug")):
        words.setdefault(t, []).append(n)
    cases = ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{n}')" for n in ns) + f" THEN '{t}' END" for t, ns in words.items())
    return f"coalesce(nullif(concat_ws('|', {cases}), ''), 'incorrect_behavior')"


_TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z_][A-Za-z0-9_]+|\\d+')"
_DOCS = "docs AS (SELECT doc_id, any_value(text) AS text FROM documents GROUP BY doc_id)"


def _bm25(k: int) -> str:
    return f"""{_DOCS}, tk AS (SELECT doc_id, {_TOKENS} AS l FROM docs), st AS (SELECT count(*) AS n, avg(len(l)) AS m FROM tk),
po AS (SELECT doc_id, token, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(l) AS len, unnest(l) AS token FROM tk) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM po GROUP BY token), rw AS (SELECT token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
w AS (SELECT token, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw),
sc AS (SELECT q.doc_id AS query_id, p.doc_id AS doc, round(sum(q.tf * idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.len / m))), 9) AS score FROM po q JOIN w USING (token) JOIN po p USING (token), st WHERE q.doc_id % 100 = 0 GROUP BY ALL),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= {k})"""


def _dense(k: int) -> str:
    return f"""ds AS (SELECT q.vec_id AS query_id, v.vec_id AS doc, round(list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM ds) WHERE rank <= {k})"""


#: What the stub makes of the texts j.
_STUB = r"""st AS (SELECT *, trim(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))[1:60]) AS short, CASE WHEN contains(text, '?') THEN 'question' ELSE 'status_update' END AS kind FROM j)"""


def _unknown(kind: str) -> str:
    return "{" + ",".join(f'"{f}":"unknown"' for f in sorted(V.METADATA_FIELDS[kind])) + "}"


_ISSUE_TEXT = f"""ri AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository, number ORDER BY fetched_at DESC, snapshot_id DESC) AS rn FROM raw_issue) WHERE rn = 1),
cu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository, issue_number ORDER BY ingested_at DESC, record_id DESC) AS rn FROM curated) WHERE rn = 1),
it AS (SELECT ri.repository, ri.number AS issue_number, {_STRIP % "coalesce(nullif(input_vector.title, ''), nullif(title, ''), '')"} AS title,
 coalesce(nullif({_STRIP % "list_filter(deliberation_thread, lambda p: coalesce(p.is_issue_body, false))[1].body"}, ''), {_STRIP % "coalesce(nullif(input_vector.body, ''), nullif(ri.body, ''), '')"}) AS body FROM ri LEFT JOIN cu ON cu.repository = ri.repository AND cu.issue_number = ri.number)"""


def oracle_sql() -> dict[str, str]:
    rules = (("proposed_solution", "text", V.SOLUTION_WORDS), ("suggestion", _FIRST, V.SUGGESTION_WORDS), ("status_update", "text", V.STATUS_WORDS), ("task_assignment", "text", V.TASK_WORDS), ("priority_discussion", _FIRST, V.PRIORITY_WORDS), ("problem_statement", "text", V.PROBLEM_WORDS))
    lines = r"list_filter(list_transform(regexp_split_to_array(text, '\r\n|\n|\r'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
    question = rf"(len(list_filter({lines}, lambda s: s LIKE '%?' AND length(s) <= 220 AND s NOT LIKE '###%')) > 0 OR regexp_matches({_FIRST}, '{_re(V.QUESTION_START)}'))"
    hits = " UNION ALL ".join([f"SELECT 'question' AS type FROM body WHERE {question}"] + [f"SELECT '{k}' FROM body WHERE regexp_matches({x}, '{_re(w)}')" for k, x, w in rules])
    topics = "CASE type " + " ".join(f"WHEN '{k}' THEN '{V.topic(k)}'" for k in V.ARTIFACT_TYPES) + " END"
    short = rf"CASE WHEN length({_SQUASH % 'summary'}) <= 220 THEN {_SQUASH % 'summary'} ELSE regexp_replace({_SQUASH % 'summary'}[:217], '\s+$', '') || '...' END"
    responses = f"""ex AS (SELECT *, row_number() OVER (PARTITION BY repository, issue_number ORDER BY comment_idx NULLS FIRST, artifact_idx NULLS FIRST, artifact_id) AS place FROM art WHERE side = 'human' AND {topics} IS NOT NULL AND {_STRIP % 'summary'} <> ''),
 rs AS (SELECT repository, issue_number, string_agg('[' || {topics} || '] ' || {short}, chr(10) ORDER BY place) AS response FROM ex WHERE place <= 5 GROUP BY ALL)"""
    by_type = FLAGS + f""", n AS (SELECT model_id, repository, count(DISTINCT issue_number) AS issues FROM f GROUP BY ALL), x AS (SELECT model_id, repository, type, sum(h * l) AS tp, sum((1 - h) * l) AS fp, sum(h * (1 - l)) AS fn FROM f GROUP BY ALL),
 bt AS (SELECT model_id, type, round(avg({_harm(_ratio('tp', '(tp + fp)'), _ratio('tp', '(tp + fn)'))}), 9) AS f1, count(*) AS repositories FROM x GROUP BY ALL)"""
    return {
        "formatted_discussion": f"WITH {RAW} SELECT r.snapshot_id, coalesce(string_agg(coalesce(nullif(login, ''), 'unknown') || ' (' || {_ROLE % 'association'} || '):' || {_SQUASH % 'p.body'}, chr(10) ORDER BY t, k), '') AS formatted_discussion FROM r LEFT JOIN (SELECT * FROM posts WHERE {_SQUASH % 'body'} <> '') p USING (snapshot_id) GROUP BY ALL",
        "file_references": "SELECT DISTINCT snapshot_id, array_to_string(files, '|') AS files FROM curated",
        "thread_posts": f"WITH {RAW} SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY opening DESC, t, k) - 1 AS pos, login AS author_login, association AS author_association, created_at, body, opening AS is_issue_body FROM posts",
        "timeline_events": f"""WITH {RAW} SELECT snapshot_id, row_number() OVER (PARTITION BY snapshot_id ORDER BY coalesce(e.createdAt, ''), k) - 1 AS pos, e.__typename AS event_type, e.createdAt AS created_at, {_login('e.actor.login')} AS actor_login,
 CASE WHEN e.__typename IN ('LabeledEvent', 'UnlabeledEvent') THEN e.label.name END AS label_name, CASE WHEN e.__typename = 'ClosedEvent' THEN e.stateReason END AS state_reason,
 CASE WHEN e.__typename = 'CrossReferencedEvent' THEN coalesce(e.willCloseTarget, false) END AS will_close_target, CASE WHEN e.__typename = 'CrossReferencedEvent' THEN e.source.number END AS source_number FROM t1 WHERE nth = 1""",
        "linked_pull_requests": f"WITH {RAW} SELECT DISTINCT snapshot_id, e.source.number AS number, e.source.title AS title, e.source.state AS state, e.source.merged AS merged, coalesce(e.willCloseTarget, false) AS will_close_target, e.createdAt AS referenced_at FROM t1 WHERE e.__typename = 'CrossReferencedEvent' AND e.source.__typename = 'PullRequest'",
        "label_sets": f"WITH {RAW} SELECT r.snapshot_id, coalesce(x.labels, '') AS labels FROM r LEFT JOIN (SELECT snapshot_id, string_agg(DISTINCT n, '|' ORDER BY n) AS labels FROM (SELECT snapshot_id, unnest(labels).name AS n FROM r) WHERE n <> '' GROUP BY ALL) x USING (snapshot_id)",
        "actor_typology": f"""WITH {RAW}, a AS (SELECT snapshot_id, {_login('author.login')} AS login, authorAssociation AS association, 'issue_author' AS role, 0 AS n FROM r UNION ALL SELECT snapshot_id, {_login('c.author.login')}, c.authorAssociation, 'commenter', 1 FROM c0 WHERE c IS NOT NULL
 UNION ALL SELECT snapshot_id, {_login('e.actor.login')}, NULL, coalesce(e.__typename, 'timeline_actor'), 0 FROM t0 WHERE e IS NOT NULL)
 SELECT snapshot_id, login, coalesce(string_agg(DISTINCT nullif(association, ''), '|' ORDER BY nullif(association, '')), '') AS author_associations, string_agg(DISTINCT role, '|' ORDER BY role) AS roles, sum(n) AS comment_count FROM a WHERE login IS NOT NULL GROUP BY ALL""",
        "dataset_summary": f"""WITH {RAW}, p AS (SELECT e FROM t0 WHERE e.__typename = 'CrossReferencedEvent' AND e.source.__typename = 'PullRequest')
 SELECT (SELECT count(*) FROM r) AS record_count, (SELECT count(DISTINCT snapshot_id) FROM (SELECT snapshot_id FROM o WHERE body <> '' UNION ALL SELECT snapshot_id FROM c0 WHERE c IS NOT NULL)) AS records_with_comments,
 (SELECT count(DISTINCT snapshot_id) FROM t0 WHERE e IS NOT NULL) AS records_with_timeline_events, (SELECT count(*) FROM p) AS linked_pull_request_count, (SELECT count(*) FROM p WHERE e.source.merged) AS merged_linked_pull_request_count""",
        "state_distribution": f"WITH {RAW} SELECT state AS issue_state, count(*) AS n FROM r GROUP BY ALL",
        "comment_count_filter": f"WITH {RAW} SELECT snapshot_id, repository, number FROM r WHERE len(list_filter(coalesce(comments, []), lambda x: x IS NOT NULL)) BETWEEN 10 AND 25",
        "display_roles": f"WITH {RAW} SELECT {_ROLE % 'association'} AS role, count(*) AS posts FROM posts GROUP BY ALL",
        "earliest_issue": f"WITH {RAW} SELECT repository, strftime(strptime(min(createdAt), '%Y-%m-%dT%H:%M:%SZ'), '%Y-%m-%d %H:%M:%S') AS created_at FROM r GROUP BY ALL",
        "rule_keyword_counts": f"WITH {RECORDS}, body AS (SELECT record_id, comment_idx, coalesce(c.body, '') AS text FROM post WHERE c IS NOT NULL AND NOT coalesce(c.is_issue_body, false) AND {_STRIP % 'c.body'} <> '') SELECT type, count(*) AS comments FROM ({hits}) GROUP BY ALL",
        "rule_tag_inference": f"WITH {RECORDS}, body AS (SELECT record_id, comment_idx, coalesce(c.body, '') AS text FROM post WHERE c IS NOT NULL) SELECT record_id, comment_idx, {_tag_sql()} AS tags FROM body",
        "comment_jobs": f"WITH {RECORDS} SELECT record_id, comment_idx, coalesce(c.author_login, '') AS author, coalesce(c.url, '') AS link, coalesce(c.body, '') AS text FROM post WHERE c IS NOT NULL AND NOT coalesce(c.is_issue_body, false)",
        "bm25_topk": f"WITH {_bm25(10)} SELECT query_id, doc, round(score, 6) AS score, rank FROM lex",
        "dense_topk": f"WITH {_dense(10)} SELECT query_id, doc, round(score, 6) AS score, rank FROM den",
        "hybrid_rrf": f"""WITH {_bm25(50)}, hb AS (SELECT doc_id, ('0x' || md5(unnest(l))[1:8])::BIGINT % 64 AS b FROM tk), hc AS (SELECT doc_id, b, count(*)::DOUBLE AS n FROM hb GROUP BY ALL), hn AS (SELECT doc_id, sqrt(sum(n * n)) AS s FROM hc GROUP BY ALL), hv AS (SELECT doc_id, b, n / s AS x FROM hc JOIN hn USING (doc_id)),
 dp AS (SELECT q.doc_id AS query_id, v.doc_id AS doc, sum(q.x * v.x) AS dot FROM hv q JOIN hv v USING (b) WHERE q.doc_id % 100 = 0 GROUP BY ALL), da AS (SELECT q.doc_id AS query_id, v.doc_id AS doc, round(coalesce(dot, 0), 9) AS score FROM docs q CROSS JOIN docs v LEFT JOIN dp ON dp.query_id = q.doc_id AND dp.doc = v.doc_id WHERE q.doc_id % 100 = 0),
 den AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM da) WHERE rank <= 50),
 u AS (SELECT query_id, doc, 0 AS list_no, rank FROM lex UNION ALL SELECT query_id, doc, 1, rank FROM den),
 fu AS (SELECT query_id, doc, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf_score, min(list_no * 1000000 + rank) AS seen FROM u GROUP BY ALL)
 SELECT query_id, doc, round(rrf_score, 9) AS rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, seen, doc) AS rank FROM fu) WHERE rank <= 20""",
        "context_budget": """WITH c AS (SELECT chunk_no, any_value(repository) AS repository, length(any_value(text)) AS chars FROM chunk GROUP BY chunk_no), w AS (SELECT *, row_number() OVER o AS place, sum(chars) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM c WHERE chars > 0 WINDOW o AS (PARTITION BY repository ORDER BY chars, chunk_no))
 SELECT repository, chunk_no, chars, place, total FROM w WHERE place <= 10 AND total <= 2000""",
        "sliding_chunks": r"""WITH c AS (SELECT chunk_no, regexp_split_to_array(regexp_replace(any_value(text), '(\r\n|\n|\r)$', ''), '\r\n|\n|\r') AS l FROM chunk WHERE text <> '' GROUP BY chunk_no), s AS (SELECT chunk_no, l, unnest(range(0, len(l), 15)) AS s FROM c),
 w AS (SELECT chunk_no, s + 1 AS start_line, least(s + 20, len(l)) AS end_line, regexp_replace(array_to_string(l[s + 1:s + 20], chr(10)), '^\s+|\s+$', '', 'g') AS t FROM s WHERE s = 0 OR s + 5 < len(l)) SELECT chunk_no, start_line, end_line, md5(t) AS text_hash FROM w WHERE t <> ''""",
        "example_responses": f"WITH {ART}, {responses} SELECT * FROM rs",
        "self_excluding_examples": f"WITH {ART}, {responses}, m AS (SELECT a.repository, a.issue_number, b.issue_number AS example_issue_number, row_number() OVER (PARTITION BY a.repository, a.issue_number ORDER BY b.issue_number) AS example_no FROM rs a JOIN rs b ON a.repository = b.repository AND a.issue_number <> b.issue_number) SELECT repository, issue_number, example_no, example_issue_number FROM m WHERE example_no <= 3",
        "model_artifacts": f"""WITH {RECORDS}, j AS (SELECT record_id, comment_idx, coalesce(c.body, '') AS text FROM post WHERE c IS NOT NULL AND NOT coalesce(c.is_issue_body, false)), {_STUB}
 SELECT record_id, comment_idx, CASE WHEN short <> '' THEN 0 END AS artifact_idx, 'ok' AS status, CASE WHEN short <> '' THEN kind END AS type, CASE WHEN short <> '' THEN short END AS summary, CASE WHEN short <> '' THEN 'incorrect_behavior' END AS tags,
 CASE WHEN short <> '' THEN CASE kind {' '.join(f"WHEN '{k}' THEN '{_unknown(k)}'" for k in ('question', 'status_update'))} END END AS metadata FROM st""",
        "model_run_counts": f"""WITH {RECORDS}, o AS (SELECT record_id, any_value(repository) AS repository, any_value(issue_number) AS issue_number FROM curated GROUP BY record_id), j AS (SELECT record_id, comment_idx, coalesce(c.body, '') AS text FROM post WHERE c IS NOT NULL AND NOT coalesce(c.is_issue_body, false)), {_STUB}
 SELECT repository, issue_number, count(DISTINCT comment_idx) AS total_comments, 0::BIGINT AS failed_comments, count(*) FILTER (short <> '') AS artifact_count FROM st JOIN o USING (record_id) GROUP BY ALL""",
        "issue_texts": f"""WITH {_ISSUE_TEXT} SELECT * FROM it""",
        "issue_responses": f"""WITH {_ISSUE_TEXT} SELECT repository, issue_number, 'stub' AS model_id, '[Question] Is this still open?' || chr(10) || '[Status] ' || title AS response, NULL::VARCHAR AS error_type FROM it""",
        "model_names": r"""WITH m AS (SELECT DISTINCT model_id, lower(trim(model_id)) AS x FROM artifact WHERE model_id IS NOT NULL), f AS (SELECT *, CASE WHEN contains(x, 'gpt') THEN 'gpt' WHEN contains(x, 'claude') OR contains(x, 'anthropic') THEN 'claude' WHEN contains(x, 'gemini') THEN 'gemini' WHEN contains(x, 'qwen') THEN 'qwen' ELSE 'other' END AS family FROM m)
 SELECT model_id, family, CASE family WHEN 'gpt' THEN 0 WHEN 'claude' THEN 1 WHEN 'gemini' THEN 2 WHEN 'qwen' THEN 3 ELSE 4 END AS family_rank,
 coalesce(try_cast(regexp_extract(CASE WHEN family IN ('gpt', 'gemini', 'qwen') THEN substr(x, instr(x, family) + length(family)) ELSE x END, '(\d+(?:\.\d*)?)', 1) AS DOUBLE), 0) + CASE WHEN family = 'claude' THEN CASE WHEN contains(x, 'opus') THEN 300 WHEN contains(x, 'sonnet') THEN 200 WHEN contains(x, 'haiku') THEN 100 ELSE 0 END ELSE 0 END AS recency,
 CASE model_id """.replace("\\", "\\") + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prompting.SHOWN.items()) + """ ELSE array_to_string(list_transform(list_filter(string_split(regexp_replace(trim(model_id), '__|[/:-]', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: CASE WHEN lower(w) IN ('gpt', 'llm', 'api') THEN upper(w) ELSE upper(w[1:1]) || lower(w[2:]) END), ' ') END AS shown FROM f""",
        "tag_f1_by_type": f"WITH {TAGS} SELECT model_id, type, round(CASE WHEN sum(hc) + sum(mc) = 0 THEN 1.0 ELSE 2.0 * sum(b)::DOUBLE / (sum(hc) + sum(mc)) END, 6) AS f1 FROM tc GROUP BY ALL",
        "type_tag_scatter": f"""WITH {TAGS}, ff AS (SELECT model_id, repository, issue_number, type, max(h) AS h, max(l) AS l FROM s GROUP BY ALL), c2 AS (SELECT model_id, repository, issue_number, sum(h * l) AS b, sum(h) AS hc, sum(l) AS mc FROM ff GROUP BY ALL), t2 AS (SELECT model_id, repository, issue_number, sum(b) AS b, sum(hc) AS hc, sum(mc) AS mc FROM tc GROUP BY ALL)
 SELECT model_id, repository, row_number() OVER (PARTITION BY model_id, repository ORDER BY issue_number) - 1 AS place, round({_harm(_ratio('c2.b', 'c2.mc'), _ratio('c2.b', 'c2.hc'))}, 6) AS x, round({_harm(_ratio('t2.b', 't2.mc'), _ratio('t2.b', 't2.hc'))}, 6) AS y FROM c2 JOIN t2 USING (model_id, repository, issue_number)""",
        "type_across_repositories": f"WITH {FLAGS}, i AS (SELECT repository, {_raw_scores('b', 'hc', 'mc')} FROM ci) SELECT count(DISTINCT repository) AS repositories, count(*) AS issues, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('precision', 'recall', 'f1', 'jaccard'))} FROM i",
        "resume_anti_join": f"WITH {ART} SELECT DISTINCT t.model_id, a.repository, a.issue_number FROM art a JOIN target t USING (repository) WHERE a.side = 'human' AND NOT EXISTS (SELECT 1 FROM art b WHERE b.side = 'model' AND b.model_id = t.model_id AND b.repository = a.repository AND b.issue_number = a.issue_number)",
        "type_ring": f"""WITH {by_type}, o AS (SELECT model_id, type, count(*) OVER (PARTITION BY model_id) AS n, row_number() OVER (PARTITION BY model_id ORDER BY f1, type) - 1 AS r FROM bt),
 z AS (SELECT *, CASE WHEN n >= 20 THEN 5 ELSE 4 END AS b FROM o), y AS (SELECT *, CAST(ceil(n / b::DOUBLE) AS BIGINT) AS size FROM z),
 w AS (SELECT *, CASE WHEN n <= 6 THEN r ELSE r % size END AS line, CASE WHEN n <= 6 THEN 0 ELSE r // size END AS run FROM y)
 SELECT model_id, type, row_number() OVER (PARTITION BY model_id ORDER BY line, CASE WHEN line % 2 = 1 THEN -run ELSE run END) AS place FROM w""",
        "tag_shares": f"WITH {ART}, t AS (SELECT side, artifact_id, {_name('u')} AS tag FROM (SELECT *, unnest(raw_tags) AS u FROM art)), m AS (SELECT side, tag, count(*) AS mentions FROM (SELECT DISTINCT side, artifact_id, tag FROM t WHERE tag IS NOT NULL) GROUP BY ALL) SELECT side, tag, mentions, round(mentions::DOUBLE / (SELECT count(DISTINCT repository) FROM art), 6) AS per_repository FROM m",
        "viewer_rows": f"""WITH {ART}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository, number ORDER BY fetched_at DESC, snapshot_id DESC) AS rn FROM raw_issue) WHERE rn = 1),
 hu AS (SELECT repository, issue_number, count(*) AS human_artifacts FROM art WHERE side = 'human' GROUP BY ALL), mo AS (SELECT repository, issue_number, model_id, count(*) AS n FROM art WHERE side = 'model' GROUP BY ALL),
 mj AS (SELECT repository, issue_number, '{{' || string_agg('"' || model_id || '":' || n, ',' ORDER BY model_id) || '}}' AS models FROM mo GROUP BY ALL)
 SELECT l.repository, l.number AS issue_number, title, state, url, human_artifacts, coalesce(models, '{{}}') AS models FROM l JOIN hu ON hu.repository = l.repository AND hu.issue_number = l.number LEFT JOIN mj ON mj.repository = l.repository AND mj.issue_number = l.number""",
        "model_routing": r"SELECT DISTINCT model_id, 'api' AS provider, model_id AS model, replace(model_id, '/', '__') AS folder, coalesce(try_cast(regexp_extract(model_id, '(\d+(?:\.\d*)?)', 1) AS DOUBLE), 0) AS recency FROM artifact WHERE model_id IS NOT NULL",
        "repository_slugs": "SELECT DISTINCT repository, replace(repository, '/', '__') AS folder, replace(replace(repository, '/', '__'), '__', '/') AS back FROM raw_issue",
        "dataset_stats": f"WITH {ART} SELECT count(DISTINCT repository) AS repositories, count(DISTINCT model_id) AS models, count(DISTINCT (repository, issue_number)) AS issues, count(*) FILTER (side = 'human') AS human_artifacts, count(*) FILTER (side = 'model') AS model_artifacts, count(DISTINCT type) AS types, (SELECT count(DISTINCT t) FROM (SELECT nullif(regexp_replace(unnest(raw_tags), '^\\s+|\\s+$', '', 'g'), '') AS t FROM art)) AS tags FROM art",
        "mean_f1_by_type": f"WITH {by_type} SELECT model_id, type, round(f1, 6) AS f1, repositories FROM bt",
        "top_types": f"WITH {by_type} SELECT model_id, type, round(f1, 6) AS f1, rank FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY f1 DESC, type) AS rank FROM bt) WHERE rank <= 12",
        "box_stats": f"WITH {FLAGS}, i AS (SELECT model_id, {_harm(_ratio('b', 'mc'), _ratio('b', 'hc'))} AS f1 FROM ci) SELECT model_id, count(*) AS issues, round(min(f1), 6) AS least, round(quantile_cont(f1, 0.25), 6) AS q1, round(quantile_cont(f1, 0.5), 6) AS median, round(quantile_cont(f1, 0.75), 6) AS q3, round(max(f1), 6) AS most, round(avg(f1), 6) AS mean FROM i GROUP BY ALL",
    }
