"""Queries on the agreement of human and model artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators import align, leaderboard, metadata_metrics, summary_metrics, tag_metrics, type_metrics
from threadloom.session import cut, table


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines that add in another order agree."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return align.aligned(table(spark, d, "artifact"))


def type_flags(spark: SparkSession, d: str, normal: bool = False) -> DataFrame:
    return type_metrics.type_flags(align.type_sets(table(spark, d, "artifact"), normal))


def tag_counts(spark: SparkSession, d: str, normal: bool = False) -> DataFrame:
    return tag_metrics.tag_counts(align.tag_sets(table(spark, d, "artifact"), normal))


def type_overlap_per_issue(spark, d):
    return rounded(type_metrics.per_issue(type_flags(spark, d)))


def type_macro(spark, d):
    return rounded(type_metrics.macro(type_metrics.per_issue(type_flags(spark, d))))


def type_vocab_overall(spark, d):
    return rounded(type_metrics.vocabulary(type_flags(spark, d)))


def type_per_type_confusion(spark, d):
    return rounded(type_metrics.per_type(type_flags(spark, d)))


def metric_targets(spark, d):
    return align.targets(align.latest_artifacts(table(spark, d, "artifact")))


def latest_artifacts(spark, d):
    return align.latest_artifacts(table(spark, d, "artifact")).select("artifact_id", "side", "repository", "issue_number", "type", F.array_join("tags", "|").alias("tags"))


def tag_pooled_grouping_sets(spark, d):
    return rounded(tag_metrics.pooled(tag_counts(spark, d)))


def tag_macro(spark, d):
    return rounded(tag_metrics.macro(tag_counts(spark, d)))


def tag_macro_by_type(spark, d):
    return rounded(tag_metrics.macro(tag_counts(spark, d), empty=0.0, by_type=True))


def type_macro_normalised(spark, d):
    return rounded(type_metrics.macro(type_metrics.per_issue(type_flags(spark, d, True))))


def tag_macro_normalised(spark, d):
    return rounded(tag_metrics.macro(tag_counts(spark, d, True)))


def tag_frequency_topk(spark, d):
    return tag_metrics.frequency(_aligned(spark, d), 25)


def phrase_similarities(spark, d):
    v = metadata_metrics.field_values(_aligned(spark, d)).where("phrase <> 'unknown'")
    side = lambda h, n: v.where(F.col("h") == h).select(*metadata_metrics.GROUP, F.col("phrase").alias(n)).distinct()
    met = side(1, "a").join(side(0, "b"), list(metadata_metrics.GROUP)).select("a", "b").distinct()
    return rounded(met.select("a", "b", *[c.alias(n) for n, c in X.similarities("a", "b").items()]))


def metadata_soft_scores(spark, d):
    out = metadata_metrics.per_issue(_aligned(spark, d), method="token_f1")
    return rounded(out.select(*align.ISSUE, "human_count", "model_count", "soft_precision", "soft_recall", "soft_f1"))


def greedy_match_counts(spark, d):
    return rounded(metadata_metrics.per_issue(_aligned(spark, d)))


def metadata_macro(spark, d):
    return rounded(metadata_metrics.macro(metadata_metrics.per_issue(_aligned(spark, d))))


def metadata_overall(spark, d):
    return rounded(metadata_metrics.overall(_aligned(spark, d)))


HARD = ("human_count", "model_count", "tp", "fp", "fn", "precision", "recall", "f1", "jaccard")


def metadata_hard_token_f1(spark, d):
    """Greedy matching per issue by a similarity that SQL has."""
    out = metadata_metrics.per_issue(_aligned(spark, d), 0.6, "token_f1")
    return rounded(out.where("human_count + model_count > 0").select(*align.ISSUE, *HARD))


def metadata_overall_token_f1(spark, d):
    """The same over whole repositories."""
    return rounded(metadata_metrics.overall(_aligned(spark, d), 0.6, "token_f1").select(*type_metrics.TARGET, *HARD))


def metadata_per_type(spark, d):
    return rounded(metadata_metrics.per_issue_type(_aligned(spark, d)))


def metadata_all_methods(spark, d):
    return rounded(metadata_metrics.all_methods(_aligned(spark, d)))


def complete_components(spark, d):
    return rounded(leaderboard.complete(_components(spark, d, False), ("type_f1", "tag_f1", "summary_token_f1")))


def summary_pairs(spark, d):
    p = summary_metrics.pairs(_aligned(spark, d))
    return rounded(p.select(*align.ISSUE, "type", "human_n", "model_n", "weight", F.col("scores.token_f1").alias("token_f1"), F.col("scores.logistic").alias("logistic")))


def coverage_penalty(spark, d):
    return rounded(summary_metrics.per_issue(_aligned(spark, d)).select(*align.ISSUE, "human_types", "model_types", "matched_types", "type_precision", "type_recall", "type_f1", "token_f1", "weighted_token_f1", "penalised_token_f1"))


def summary_per_type(spark, d):
    return rounded(summary_metrics.per_type(_aligned(spark, d)))


def summary_overall(spark, d):
    a = _aligned(spark, d)
    return rounded(summary_metrics.overall(summary_metrics.per_issue(a), summary_metrics.per_type(a)))


def summary_vectors(spark, d):
    """Summaries scored by token vectors (greatest cosines, and the cosine of the means); the vectors are hashed tokens."""
    return rounded(summary_metrics.per_issue(_aligned(spark, d), summary_metrics.vectors, ("precision", "recall", "f1", "cosine")))


def logistic_scores(spark, d):
    raw = F.col("value") / 100 - F.lit(0.5)
    return rounded(table(spark, d, "events").select("event_id", X.logistic_score(raw).alias("sigmoid"), X.logistic_score(raw, "clip").alias("clipped"), X.logistic_score(raw, "raw").alias("raw")))


def _components(spark, d, fuzzy: bool) -> DataFrame:
    """The components that can be had without model weights; fuzzy adds the two of metadata matching.

    The plan of the latter is long and boards use components several times, so with it the lineage is cut before and after.
    """
    a = cut(_aligned(spark, d)) if fuzzy else _aligned(spark, d)
    flags, counts = type_flags(spark, d), tag_counts(spark, d)
    summary = summary_metrics.per_issue(a).groupBy(*type_metrics.TARGET).agg(X.mean("penalised_token_f1").alias("f1"))
    reports = [("type_f1", type_metrics.macro(type_metrics.per_issue(flags)), "f1"), ("tag_f1", tag_metrics.pooled(counts).where("level = 'overall'"), "f1"), ("summary_token_f1", summary, "f1")]
    if fuzzy:
        m = cut(metadata_metrics.macro(metadata_metrics.per_issue(a)))
        reports += [("metadata_f1", m, "f1"), ("metadata_soft_f1", m, "soft_f1")]
    c = leaderboard.unpivot(reports).withColumn("value", F.round("value", 9))
    return cut(c) if fuzzy else c


def leaderboard_components(spark, d):
    return rounded(_components(spark, d, False))


def leaderboard_rrf(spark, d):
    return rounded(leaderboard.per_repository(_components(spark, d, False)))


def leaderboard_combined(spark, d):
    return rounded(leaderboard.combined(_components(spark, d, False)))


def leaderboard_with_metadata(spark, d):
    return rounded(leaderboard.combined(_components(spark, d, True)))


def profile_points(spark, d):
    return rounded(leaderboard.profile_points(_components(spark, d, False), ("type_f1", "tag_f1", "summary_token_f1")))


# The boards above hold the three components that SQL can express and are checked against it. Those below hold all that can be
# had without model weights; they have no SQL, as greedy matching can't be written in it.

#: The reference's seven components; the lexical summary score stands in the place of the first neural one, the other two are missing.
PROFILE = ("type_f1", "metadata_f1", "metadata_soft_f1", "tag_f1", "summary_token_f1", "summary_bertscore_f1", "summary_bleurt")


def leaderboard_components_with_metadata(spark, d):
    return rounded(_components(spark, d, True))


def leaderboard_rrf_with_metadata(spark, d):
    return rounded(leaderboard.per_repository(_components(spark, d, True)))


def complete_components_with_metadata(spark, d):
    return rounded(leaderboard.complete(_components(spark, d, True), PROFILE[:5]))


def profile_points_with_metadata(spark, d):
    return rounded(leaderboard.profile_points(_components(spark, d, True), PROFILE))


def points_quantised(spark, d):
    e = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))
    return e.select("o_orderkey", X.quantise("x", 10, 1000).cast("long").alias("points"), X.quantise("x", 1, 100).cast("long").alias("points_100"))


QUERIES = (
    type_overlap_per_issue, type_macro, type_vocab_overall, type_per_type_confusion, metric_targets, latest_artifacts, tag_pooled_grouping_sets, tag_macro, tag_macro_by_type, type_macro_normalised, tag_macro_normalised, tag_frequency_topk, phrase_similarities,
    metadata_soft_scores, greedy_match_counts, metadata_macro, metadata_overall, metadata_hard_token_f1, metadata_overall_token_f1, metadata_per_type, metadata_all_methods, complete_components, summary_pairs, coverage_penalty, summary_per_type, summary_overall, summary_vectors, logistic_scores, leaderboard_components, leaderboard_rrf, leaderboard_combined, leaderboard_with_metadata, profile_points, leaderboard_components_with_metadata, leaderboard_rrf_with_metadata, complete_components_with_metadata, profile_points_with_metadata, points_quantised,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


# ---------------------------------------------------------------- SQL


def _snake(x: str) -> str:
    return rf"nullif(translate(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), ' -', '__'), '')"


def _name(x: str) -> str:
    return rf"nullif(regexp_replace({x}, '^\s+|\s+$', '', 'g'), '')"


def _ratio(n: str, d: str) -> str:
    return f"(CASE WHEN {d} = 0 THEN CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE ({n})::DOUBLE / ({d}) END)"


def _harm(p: str, r: str) -> str:
    return f"(CASE WHEN {p} + {r} = 0 THEN 0.0::DOUBLE ELSE 2 * {p} * {r} / ({p} + {r}) END)"


def _scores(both: str, human: str, model: str) -> str:
    p, r = _ratio(both, model), _ratio(both, human)
    return f"round({p}, 6) AS precision, round({r}, 6) AS recall, round({_harm(p, r)}, 6) AS f1, round({_ratio(both, f'({human} + {model} - {both})')}, 6) AS jaccard"


def _raw_scores(both: str, human: str, model: str) -> str:
    p, r = _ratio(both, model), _ratio(both, human)
    return f"{p} AS precision, {r} AS recall, {_harm(p, r)} AS f1, {_ratio(both, f'({human} + {model} - {both})')} AS jaccard"


def _bases(name) -> tuple[str, str, str]:
    """The last state of each artifact on both sides, types by issue, and tags by issue and type; name: how names are compared."""
    art = rf"""
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY extracted_at DESC NULLS LAST, type DESC) AS rn FROM artifact) WHERE rn = 1),
art AS (SELECT artifact_id, side, model_id, repository, issue_number, comment_idx, artifact_idx, {name("type")} AS type, summary, tags AS raw_tags, metadata FROM last WHERE {name("type")} IS NOT NULL),
target AS (SELECT DISTINCT model_id, repository FROM art WHERE side = 'model'),
s AS (
  SELECT t.model_id, a.repository, a.issue_number, a.comment_idx, a.artifact_idx, a.artifact_id, a.type, a.summary, a.raw_tags, a.metadata, 1 AS h, 0 AS l FROM art a JOIN target t USING (repository) WHERE a.side = 'human'
  UNION ALL SELECT model_id, repository, issue_number, comment_idx, artifact_idx, artifact_id, type, summary, raw_tags, metadata, 0, 1 FROM art WHERE side = 'model')"""
    flags = art + """,
f AS (SELECT model_id, repository, issue_number, type, max(h) AS h, max(l) AS l FROM s GROUP BY ALL),
ci AS (SELECT model_id, repository, issue_number, sum(h * l) AS b, sum(h) AS hc, sum(l) AS mc FROM f GROUP BY ALL)"""
    tags = art + rf""",
g AS (SELECT model_id, repository, issue_number, type, artifact_id, h, l, {name("u")} AS tag FROM (SELECT *, unnest(raw_tags) AS u FROM s) WHERE {name("u")} IS NOT NULL),
tf AS (SELECT model_id, repository, issue_number, type, tag, max(h) AS h, max(l) AS l FROM g GROUP BY ALL),
ts AS (SELECT model_id, repository, issue_number, type, sum(h * l) AS b, sum(h) AS hc, sum(l) AS mc FROM tf GROUP BY ALL),
ty AS (SELECT model_id, repository, issue_number, type, max(h) AS has_h, max(l) AS has_l, max(h) * max(l) AS shared FROM s GROUP BY ALL),
tc AS (SELECT ty.*, coalesce(b, 0) * shared AS b, coalesce(hc, 0) * shared AS hc, coalesce(mc, 0) * shared AS mc FROM ty LEFT JOIN ts USING (model_id, repository, issue_number, type))"""
    return art, flags, tags


ART, FLAGS, TAGS = _bases(_name)
_, FLAGS_NORMAL, TAGS_NORMAL = _bases(_snake)

PHRASE = r"trim(regexp_replace(regexp_replace(lower(%s), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
STRIP = r"regexp_replace(%s, '^\s+|\s+$', '', 'g')"

VALUES = ART + f""",
e AS (SELECT model_id, repository, issue_number, type, comment_idx, artifact_idx, artifact_id, h, l, unnest(map_entries(metadata)) AS kv FROM s),
v AS (SELECT model_id, repository, issue_number, type, comment_idx, artifact_idx, artifact_id, {STRIP % "kv.key"} AS field, h, {STRIP % "kv.value"} AS value, {PHRASE % ("(" + STRIP % "kv.value" + ")")} AS phrase FROM e),
vv AS (SELECT * FROM v WHERE value <> '' AND field <> '')"""

_X, _Y = "list_distinct(list_filter(string_split(a, ' '), lambda t: t <> ''))", "list_distinct(list_filter(string_split(b, ' '), lambda t: t <> ''))"
_G = "list_distinct(list_transform(range(1, greatest(length(' ' || %s || ' ') - 1, 2)), lambda i: substr(' ' || %s || ' ', i::BIGINT, 3)))"
_BOTH, _GB = f"len(list_intersect({_X}, {_Y}))", f"len(list_intersect({_G % ('a', 'a')}, {_G % ('b', 'b')}))"


def _sim(expr: str) -> str:
    return f"(CASE WHEN a = '' AND b = '' THEN 1.0::DOUBLE WHEN a = '' OR b = '' THEN 0.0::DOUBLE ELSE {expr} END)"


TOKEN_F1 = _sim(_harm(f"({_BOTH}::DOUBLE / len({_Y}))", f"({_BOTH}::DOUBLE / len({_X}))"))
SIMS = {
    "token_f1": TOKEN_F1,
    "token_jaccard": _sim(f"{_BOTH}::DOUBLE / (len({_X}) + len({_Y}) - {_BOTH})"),
    "token_containment": _sim(f"{_BOTH}::DOUBLE / least(len({_X}), len({_Y}))"),
    "char_ngram_jaccard": _sim(f"{_GB}::DOUBLE / (len({_G % ('a', 'a')}) + len({_G % ('b', 'b')}) - {_GB})"),
}
GROUP = "model_id, repository, issue_number, type, field"

SUMMARIES = ART + f""",
sm AS (SELECT *, {STRIP % "summary"} AS text FROM s WHERE {STRIP % "summary"} <> ''),
c AS (SELECT model_id, repository, issue_number, type, sum(h) AS human_n, sum(l) AS model_n,
  coalesce(string_agg(CASE WHEN h = 1 THEN text END, chr(10) ORDER BY comment_idx NULLS FIRST, artifact_idx NULLS FIRST, artifact_id), '') AS human_text,
  coalesce(string_agg(CASE WHEN l = 1 THEN text END, chr(10) ORDER BY comment_idx NULLS FIRST, artifact_idx NULLS FIRST, artifact_id), '') AS model_text
  FROM sm GROUP BY ALL),
p0 AS (SELECT *, greatest(human_n, 1)::DOUBLE AS weight, {PHRASE % "human_text"} AS a, {PHRASE % "model_text"} AS b FROM c WHERE human_n > 0 AND model_n > 0),
p AS (SELECT *, {TOKEN_F1} AS token_f1 FROM p0),
k AS (SELECT model_id, repository, issue_number, count(*) FILTER (human_n > 0) AS human_types, count(*) FILTER (model_n > 0) AS model_types, count(*) FILTER (human_n > 0 AND model_n > 0) AS matched_types FROM c GROUP BY ALL),
q AS (SELECT model_id, repository, issue_number, avg(token_f1) AS token_f1, sum(weight * token_f1) / sum(weight) AS weighted_token_f1 FROM p GROUP BY ALL),
i0 AS (SELECT u.*, coalesce(human_types, 0) AS human_types, coalesce(model_types, 0) AS model_types, coalesce(matched_types, 0) AS matched_types, coalesce(token_f1, 0) AS token_f1, coalesce(weighted_token_f1, 0) AS weighted_token_f1
  FROM (SELECT DISTINCT model_id, repository, issue_number FROM s) u LEFT JOIN k USING (model_id, repository, issue_number) LEFT JOIN q USING (model_id, repository, issue_number)),
i AS (SELECT *, {_ratio("matched_types", "model_types")} AS type_precision, {_ratio("matched_types", "human_types")} AS type_recall FROM i0)"""

def _greedy(group: str, keys: str) -> str:
    """Greedy matching step by step: of each group the best pair that is left, until none is at the threshold."""
    over = "coalesce(issue_number, 0), coalesce(comment_idx, 0), coalesce(artifact_idx, 0), artifact_id"
    return f"""WITH RECURSIVE {VALUES}, n AS (SELECT {keys}, sum(h) AS human_count, sum(1 - h) AS model_count FROM vv GROUP BY ALL),
 o AS (SELECT dense_rank() OVER (ORDER BY {group}) AS g, {group}, h, phrase, row_number() OVER (PARTITION BY {group}, h ORDER BY {over}) AS k FROM vv),
 met AS (SELECT x.g, x.k AS i, y.k AS j, x.phrase AS a, y.phrase AS b FROM o x JOIN o y ON x.g = y.g AND x.h = 1 AND y.h = 0), d AS (SELECT a, b, {TOKEN_F1} AS sim FROM (SELECT DISTINCT a, b FROM met)),
 near AS (SELECT g, i, j, row_number() OVER (PARTITION BY g ORDER BY sim DESC, i, j) AS ord FROM met JOIN d USING (a, b) WHERE sim >= 0.6),
 rec AS (SELECT DISTINCT g, 0 AS tp, []::BIGINT[] AS hs, []::BIGINT[] AS ms FROM near UNION ALL
  SELECT g, tp + 1, list_append(hs, p.i), list_append(ms, p.j) FROM (SELECT rec.g, any_value(tp) AS tp, any_value(hs) AS hs, any_value(ms) AS ms, arg_min(struct_pack(i := i, j := j), ord) AS p FROM rec JOIN near ON near.g = rec.g AND NOT list_contains(hs, i) AND NOT list_contains(ms, j) GROUP BY rec.g)),
 t AS (SELECT g, max(tp) AS tp FROM rec GROUP BY g), q AS (SELECT {keys}, sum(tp)::BIGINT AS tp FROM t JOIN (SELECT DISTINCT g, {keys} FROM o) USING (g) GROUP BY ALL),
 z AS (SELECT n.*, coalesce(tp, 0) AS tp FROM n LEFT JOIN q USING ({keys}))
 SELECT {keys}, human_count, model_count, tp, model_count - tp AS fp, human_count - tp AS fn, {_scores("tp", "human_count", "model_count")} FROM z"""


def _joined(flag: str) -> str:
    return f"coalesce(string_agg(CASE WHEN {flag} = 1 THEN text END, chr(10) ORDER BY issue_number, comment_idx NULLS FIRST, artifact_idx NULLS FIRST, artifact_id), '')"


COMPONENTS = (
    "WITH " + FLAGS + TAGS.removeprefix(ART) + SUMMARIES.removeprefix(ART) + f""",
comp AS (
  SELECT repository, model_id, 'type_f1' AS component, round(avg(f1), 9) AS value FROM (SELECT *, {_harm(_ratio("b", "mc"), _ratio("b", "hc"))} AS f1 FROM ci) GROUP BY ALL
  UNION ALL SELECT repository, model_id, 'tag_f1', round({_harm(_ratio("b", "mc"), _ratio("b", "hc"))}, 9) FROM (SELECT repository, model_id, sum(b) AS b, sum(hc) AS hc, sum(mc) AS mc FROM tc GROUP BY ALL)
  UNION ALL SELECT repository, model_id, 'summary_token_f1', round(avg(token_f1 * type_recall), 9) FROM i GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY repository, component ORDER BY value DESC, model_id) AS rank FROM comp)"""
)


def _points(keys: str, extra: str = "") -> str:
    over = f"OVER ({keys} ORDER BY score DESC, model_id)"
    pts = "least(greatest(round_even(CASE WHEN max_score <= 0 THEN 0 ELSE score / max_score END * 100, 0)::BIGINT, 0), 100)"
    return f"row_number() {over} AS rank, model_id, round(score, 6) AS score, round(max_score, 6) AS max_score, round(CASE WHEN max_score <= 0 THEN 0 ELSE score / max_score END * 100, 6) AS normalized_score, {pts} AS points, first_value({pts}) {over} - {pts} AS points_to_leader{extra}"


def oracle_sql() -> dict[str, str]:
    issue = "model_id, repository, issue_number"
    out = {
        "type_overlap_per_issue": f"WITH {FLAGS} SELECT {issue}, b AS intersection_count, hc AS human_count, mc AS model_count, hc + mc - b AS union_count, {_scores('b', 'hc', 'mc')} FROM ci",
        "type_macro": f"WITH {FLAGS} SELECT model_id, repository, count(*) AS issue_count, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('precision', 'recall', 'f1', 'jaccard'))} FROM (SELECT model_id, repository, {_raw_scores('b', 'hc', 'mc')} FROM ci) GROUP BY ALL",
        "type_vocab_overall": f"WITH {FLAGS}, w AS (SELECT model_id, repository, type, max(h) AS h, max(l) AS l FROM f GROUP BY ALL), x AS (SELECT model_id, repository, sum(h * l) AS b, sum(h) AS hc, sum(l) AS mc FROM w GROUP BY ALL) SELECT model_id, repository, b AS intersection_count, hc AS human_count, mc AS model_count, hc + mc - b AS union_count, {_scores('b', 'hc', 'mc')} FROM x",
        "type_per_type_confusion": f"WITH {FLAGS}, n AS (SELECT model_id, repository, count(DISTINCT issue_number) AS issues FROM f GROUP BY ALL), x AS (SELECT model_id, repository, type, sum(h * l) AS tp, sum((1 - h) * l) AS fp, sum(h * (1 - l)) AS fn FROM f GROUP BY ALL) SELECT model_id, repository, type, tp, fp, fn, issues - tp - fp - fn AS tn, {_scores('tp', '(tp + fn)', '(tp + fp)')} FROM x JOIN n USING (model_id, repository)",
        "metric_targets": f"WITH {ART} SELECT * FROM target",
        "latest_artifacts": f"WITH {ART} SELECT artifact_id, side, repository, issue_number, type, coalesce((SELECT string_agg(t, '|' ORDER BY k) FROM (SELECT t, min(k) AS k FROM (SELECT {_name('u.x')} AS t, u.k FROM (SELECT unnest(raw_tags) AS x, generate_subscripts(raw_tags, 1) AS k) u) WHERE t IS NOT NULL GROUP BY t)), '') AS tags FROM art",
        "tag_pooled_grouping_sets": f"""WITH {TAGS}, x AS (SELECT model_id, repository, issue_number, type, CASE grouping(issue_number, type) WHEN 3 THEN 'overall' WHEN 1 THEN 'issue' ELSE 'type' END AS level, sum(shared) AS compared_count, sum(has_h) AS human_issue_count, sum(has_l) AS model_issue_count, sum(b) AS b, sum(hc) AS hc, sum(mc) AS mc
 FROM tc GROUP BY GROUPING SETS ((model_id, repository), (model_id, repository, issue_number), (model_id, repository, type))) SELECT level, model_id, repository, issue_number, type, compared_count, human_issue_count, model_issue_count, b AS intersection_count, hc AS human_count, mc AS model_count, {_scores('b', 'hc', 'mc')} FROM x""",
        "tag_macro": f"WITH {TAGS}, x AS (SELECT {issue}, sum(b) AS b, sum(hc) AS hc, sum(mc) AS mc FROM tc GROUP BY ALL) SELECT model_id, repository, count(*) AS issue_count, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('precision', 'recall', 'f1', 'jaccard'))} FROM (SELECT model_id, repository, {_raw_scores('b', 'hc', 'mc')} FROM x) GROUP BY ALL",
        "tag_macro_by_type": f"WITH {TAGS}, x AS (SELECT {issue}, {', '.join(f'coalesce(avg({m}) FILTER (shared = 1), 0) AS {m}' for m in ('precision', 'recall', 'f1', 'jaccard'))} FROM (SELECT {issue}, shared, {_raw_scores('b', 'hc', 'mc')} FROM tc) GROUP BY ALL) SELECT model_id, repository, count(*) AS issue_count, {', '.join(f'round(avg({m}), 6) AS {m}' for m in ('precision', 'recall', 'f1', 'jaccard'))} FROM x GROUP BY ALL",
        "tag_frequency_topk": f"WITH {TAGS}, hm AS (SELECT tag, count(*) AS n FROM (SELECT DISTINCT artifact_id, tag FROM g WHERE h = 1) GROUP BY tag), mm AS (SELECT tag, count(*) AS n FROM (SELECT DISTINCT artifact_id, tag FROM g WHERE l = 1) GROUP BY tag) SELECT tag, coalesce(hm.n, 0) AS human_mentions, coalesce(mm.n, 0) AS model_mentions, coalesce(hm.n, 0) + coalesce(mm.n, 0) AS total FROM hm FULL JOIN mm USING (tag) ORDER BY total DESC, tag LIMIT 25",
        "phrase_similarities": f"WITH {VALUES}, w AS (SELECT DISTINCT {GROUP}, h, phrase FROM vv WHERE phrase <> 'unknown'), m AS (SELECT DISTINCT x.phrase AS a, y.phrase AS b FROM w x JOIN w y USING ({GROUP}) WHERE x.h = 1 AND y.h = 0) SELECT a, b, {', '.join(f'round({q}, 6) AS {n}' for n, q in SIMS.items())} FROM m",
        "metadata_soft_scores": f"""WITH {VALUES}, n AS (SELECT {issue}, sum(h) AS human_count, sum(1 - h) AS model_count FROM vv GROUP BY ALL),
 hp AS (SELECT {GROUP}, phrase AS a, count(*) AS k FROM vv WHERE h = 1 GROUP BY ALL), mp AS (SELECT {GROUP}, phrase AS b, count(*) AS k FROM vv WHERE h = 0 GROUP BY ALL),
 met AS (SELECT {GROUP}, a, b, hp.k AS hk, mp.k AS mk FROM hp JOIN mp USING ({GROUP})), d AS (SELECT a, b, {TOKEN_F1} AS sim FROM (SELECT DISTINCT a, b FROM met)),
 bh AS (SELECT {issue}, sum(x * hk) AS sh FROM (SELECT {GROUP}, a, max(sim) AS x, max(hk) AS hk FROM met JOIN d USING (a, b) GROUP BY ALL) GROUP BY ALL), bm AS (SELECT {issue}, sum(x * mk) AS sm FROM (SELECT {GROUP}, b, max(sim) AS x, max(mk) AS mk FROM met JOIN d USING (a, b) GROUP BY ALL) GROUP BY ALL),
 z AS (SELECT u.*, coalesce(human_count, 0) AS human_count, coalesce(model_count, 0) AS model_count, coalesce(sh, 0) AS sh, coalesce(sm, 0) AS sm FROM (SELECT DISTINCT {issue} FROM s) u LEFT JOIN n USING ({issue}) LEFT JOIN bh USING ({issue}) LEFT JOIN bm USING ({issue})),
 y AS (SELECT *, CASE WHEN model_count = 0 THEN 1.0::DOUBLE ELSE sm / model_count END AS sp, CASE WHEN human_count = 0 THEN 1.0::DOUBLE ELSE sh / human_count END AS sr FROM z)
 SELECT {issue}, human_count, model_count, round(sp, 6) AS soft_precision, round(sr, 6) AS soft_recall, round({_harm('sp', 'sr')}, 6) AS soft_f1 FROM y""",
        "summary_pairs": f"WITH {SUMMARIES} SELECT {issue}, type, human_n, model_n, weight, round(token_f1, 6) AS token_f1, round(1 / (1 + exp(-token_f1 / 2)), 6) AS logistic FROM p",
        "coverage_penalty": f"WITH {SUMMARIES} SELECT {issue}, human_types, model_types, matched_types, round(type_precision, 6) AS type_precision, round(type_recall, 6) AS type_recall, round({_harm('type_precision', 'type_recall')}, 6) AS type_f1, round(token_f1, 6) AS token_f1, round(weighted_token_f1, 6) AS weighted_token_f1, round(token_f1 * type_recall, 6) AS penalised_token_f1 FROM i",
        "logistic_scores": "SELECT event_id, round(1 / (1 + exp(-least(greatest((value / 100 - 0.5) / 2, -60), 60))), 6) AS sigmoid, round(greatest(value / 100 - 0.5, 0), 6) AS clipped, round(value / 100 - 0.5, 6) AS raw FROM events",
        "leaderboard_components": COMPONENTS + " SELECT repository, model_id, component, round(value, 6) AS value FROM comp",
        "complete_components": COMPONENTS + " SELECT repository, model_id, component, round(value, 6) AS value FROM comp WHERE (repository, model_id) IN (SELECT (repository, model_id) FROM comp GROUP BY repository, model_id HAVING count(DISTINCT component) = 3)",
        "leaderboard_rrf": COMPONENTS + f", sc AS (SELECT repository, model_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM rk GROUP BY ALL), mx AS (SELECT repository, count(DISTINCT component) / 61.0::DOUBLE AS max_score FROM rk GROUP BY ALL), j AS (SELECT * FROM sc JOIN mx USING (repository)) SELECT repository, {_points('PARTITION BY repository')} FROM j",
        "leaderboard_combined": COMPONENTS + f", sc AS (SELECT model_id, sum(1.0::DOUBLE / (60 + rank)) AS score, count(DISTINCT repository) AS repo_count FROM rk GROUP BY ALL), mx AS (SELECT count(*) / 61.0::DOUBLE AS max_score FROM (SELECT DISTINCT repository, component FROM rk)), j AS (SELECT * FROM sc, mx) SELECT {_points('', ', repo_count')} FROM j",
        "profile_points": COMPONENTS + ", mv AS (SELECT model_id, component, avg(value) AS v FROM comp GROUP BY ALL), w AS (SELECT model_id, coalesce(max(v) FILTER (component = 'type_f1'), 0) AS type_f1, coalesce(max(v) FILTER (component = 'tag_f1'), 0) AS tag_f1, coalesce(max(v) FILTER (component = 'summary_token_f1'), 0) AS summary_token_f1 FROM mv GROUP BY ALL) SELECT model_id, round(type_f1, 6) AS type_f1, round(tag_f1, 6) AS tag_f1, round(summary_token_f1, 6) AS summary_token_f1, round((type_f1 + tag_f1 + summary_token_f1) / 3, 6) AS composite, round_even((type_f1 + tag_f1 + summary_token_f1) / 3 * 100, 0)::BIGINT AS points FROM w",
        "points_quantised": "SELECT o_orderkey, least(greatest(round_even(o_totalprice / 1000 / 10, 0)::BIGINT * 10, 0), 1000) AS points, least(greatest(round_even(o_totalprice / 1000, 0)::BIGINT, 0), 100) AS points_100 FROM orders",
    }
    by_type = f"""{SUMMARIES}, tt AS (SELECT model_id, repository, type, count(*) FILTER (human_n > 0) AS human_issues, count(*) FILTER (model_n > 0) AS model_issues, count(*) FILTER (human_n > 0 AND model_n > 0) AS matched_issues FROM c GROUP BY ALL),
 ms AS (SELECT sm.* FROM sm JOIN (SELECT model_id, repository, issue_number, type FROM c WHERE human_n > 0 AND model_n > 0) USING (model_id, repository, issue_number, type)),
 mt AS (SELECT model_id, repository, type, {PHRASE % _joined("h")} AS a, {PHRASE % _joined("l")} AS b FROM ms GROUP BY ALL),
 sc AS (SELECT model_id, repository, type, {TOKEN_F1} AS token_f1, {SIMS["char_ngram_jaccard"]} AS trigram FROM mt),
 y AS (SELECT tt.*, coalesce(token_f1, 0) AS token_f1, coalesce(trigram, 0) AS trigram, CASE WHEN token_f1 IS NULL THEN 0 ELSE 1 / (1 + exp(-token_f1 / 2)) END AS logistic, {_ratio("matched_issues", "human_issues")} AS issue_recall FROM tt LEFT JOIN sc USING (model_id, repository, type))"""
    scores = ", ".join(f"round({n}, 6) AS {n}, round({n} * issue_recall, 6) AS penalised_{n}" for n in ("token_f1", "trigram", "logistic"))
    out["summary_per_type"] = f"WITH {by_type} SELECT model_id, repository, type, human_issues, model_issues, matched_issues, round(issue_recall, 6) AS issue_recall, {scores} FROM y"
    coverage = ", ".join(f"avg({x}) AS coverage_{n}" for n, x in (("precision", "type_precision"), ("recall", "type_recall"), ("f1", _harm("type_precision", "type_recall"))))
    out["summary_overall"] = f"""WITH {by_type}, ov AS (SELECT model_id, repository, coalesce(avg(token_f1) FILTER (matched_types > 0), 0) AS matched_only_macro, avg(token_f1 * type_recall) AS all_issues_with_penalty, avg(token_f1) AS all_issues_raw,
 CASE WHEN sum(matched_types) = 0 THEN 0 ELSE sum(matched_types * weighted_token_f1) / sum(matched_types) END AS support_weighted, {coverage} FROM i GROUP BY ALL),
 oy AS (SELECT model_id, repository, coalesce(avg(token_f1) FILTER (matched_issues > 0), 0) AS per_type_matched_only, avg(token_f1 * issue_recall) AS per_type_with_penalty FROM y GROUP BY ALL)
 SELECT ov.model_id, ov.repository, {', '.join(f'round({c}, 6) AS {c}' for c in ('matched_only_macro', 'all_issues_with_penalty', 'all_issues_raw', 'support_weighted', 'coverage_precision', 'coverage_recall', 'coverage_f1'))},
 round(matched_only_macro * coverage_recall, 6) AS penalised_overall, round(coalesce(per_type_matched_only, 0), 6) AS per_type_matched_only, round(coalesce(per_type_with_penalty, 0), 6) AS per_type_with_penalty FROM ov LEFT JOIN oy USING (model_id, repository)"""
    out["metadata_hard_token_f1"] = _greedy(GROUP, issue)
    out["metadata_overall_token_f1"] = _greedy("model_id, repository, type, field", "model_id, repository")
    # the same with names compared in small letters and underscores
    return out | {"type_macro_normalised": out["type_macro"].replace(FLAGS, FLAGS_NORMAL), "tag_macro_normalised": out["tag_macro"].replace(TAGS, TAGS_NORMAL)}
