import difflib
import random

import pytest
from pyspark.sql import functions as F

from threadloom.functions import exprs as X
from threadloom.operators import align, leaderboard, metadata_metrics, summary_metrics, tag_metrics, type_metrics

SCHEMA = "artifact_id long, side string, model_id string, repository string, issue_number long, comment_idx int, artifact_idx int, extracted_at timestamp, type string, summary string, tags array<string>, metadata map<string,string>, extra string"


def artifacts(spark, rows):
    """rows: (side, issue, type, tags, metadata, summary)."""
    out = [(k, side, "m" if side == "model" else None, "r", issue, 0, k, None, kind, summary, tags, meta, "x") for k, (side, issue, kind, tags, meta, summary) in enumerate(rows)]
    return align.aligned(spark.createDataFrame(out, SCHEMA), normal=True)


def row(side, kind, tags=(), meta=None, summary="s", issue=1):
    return side, issue, kind, list(tags), meta or {}, summary


def test_type_scores(spark):
    a = artifacts(spark, [row("human", "problem_statement"), row("human", "question"), row("human", " Proposed-Solution"), row("model", "problem_statement"), row("model", "alternative_solution")])
    f = type_metrics.type_flags(a)
    r = type_metrics.per_issue(f).first()
    assert (r.intersection_count, r.union_count, r.precision, r.jaccard) == (1, 4, 0.5, 0.25) and abs(r.recall - 1 / 3) < 1e-12 and abs(r.f1 - 0.4) < 1e-12
    by = {x.type: x for x in type_metrics.per_type(f).collect()}
    assert by["problem_statement"].f1 == 1 and by["question"].recall == 0 and by["alternative_solution"].precision == 0 and by["question"].tn == 0


def test_missing_side(spark):
    a = artifacts(spark, [row("human", "question", issue=1), row("model", "question", issue=2)])
    by = {r.issue_number: r for r in type_metrics.per_issue(type_metrics.type_flags(a)).collect()}
    assert (by[1].precision, by[1].recall, by[1].f1, by[1].jaccard) == (1, 0, 0, 0)


def test_tags(spark):
    a = artifacts(spark, [row("human", "question", ["bug", "runtime_error", " Bug", None]), row("model", "question", ["bug", "performance issue"]), row("human", "critique", ["api"], issue=2), row("model", "rationale", ["api"], issue=2)])
    p = {(r.level, r.issue_number, r.type): r for r in tag_metrics.pooled(tag_metrics.tag_counts(a)).collect()}
    one = p["issue", 1, None]
    assert (one.intersection_count, one.human_count, one.model_count, one.precision, one.recall) == (1, 2, 2, 0.5, 0.5) and abs(one.jaccard - 1 / 3) < 1e-12
    assert p["issue", 2, None].f1 == 1.0
    assert tag_metrics.macro(tag_metrics.tag_counts(a), 0.0, True).first().f1 == 0.25


def test_phrases(spark):
    df = spark.createDataFrame([("Kubelet checkpoint handling", "Kubelet internal checkpoint handling"), ("Incorrect behavior of a method", "Method behaves incorrectly"), ("", ""), ("x", "")], "a string, b string").select(X.phrase("a").alias("a"), X.phrase("b").alias("b"))
    got = [[round(v, 6) for v in r] for r in df.select(*X.similarities("a", "b").values()).collect()]
    assert got[0] == [0.857143, 0.75, 1.0, 0.722222] and got[1] == [0.25, 0.142857, 0.333333, 0.473684] and got[2] == [1] * 4 and got[3] == [0] * 4
    m = metadata_metrics.phrase_similarity(spark.createDataFrame([("tide", "diet")], "a string, b string"), "sequence_ratio").first()
    assert (m.forward, m.backward) == (0.25, 0.5)


def _similar(a, b):
    x, y = set(a.split()), set(b.split())
    g, h = ({(" " + s + " ")[i : i + 3] for i in range(len(s))} for s in (a, b))
    n = len(x & y)
    return max(2 * n / (len(x) + len(y)), n / len(x | y), n / min(len(x), len(y)), len(g & h) / len(g | h), difflib.SequenceMatcher(None, a, b).ratio())


def test_greedy_against_brute_force(spark):
    rng = random.Random(3)
    words = ["cache", "parser", "slow parser", "parser slow", "cold cache", "disk", "disks", "cash"]
    rows = []
    for issue in range(25):
        for side in ("human", "model"):
            rows += [row(side, "question", meta={"target_area": rng.choice(words)}, issue=issue) for _ in range(rng.randrange(0, 5))]
    rows += [row("model", "question", meta={"target_area": "unknown"}, issue=0), row("human", "question", meta={"target_area": " "}, issue=0)]
    got = {r.issue_number: r for r in metadata_metrics.per_issue(artifacts(spark, rows), 0.82).collect()}
    for issue, r in got.items():
        h = [x[4]["target_area"] for x in rows if x[0] == "human" and x[1] == issue and x[4]["target_area"].strip()]
        m = [x[4]["target_area"] for x in rows if x[0] == "model" and x[1] == issue and x[4]["target_area"].strip()]
        pairs = sorted(((-_similar(a, b), i, j) for i, a in enumerate(h) for j, b in enumerate(m)), key=lambda p: (p[0], p[1], p[2]))
        hs, ms, tp = set(), set(), 0
        for s, i, j in pairs:
            if i not in hs and j not in ms:
                hs.add(i)
                ms.add(j)
                tp += -s >= 0.82
        assert (r.human_count, r.model_count, r.tp) == (len(h), len(m), tp), issue
        if h and m:
            assert abs(r.soft_recall - sum(max(_similar(a, b) for b in m) for a in h) / len(h)) < 1e-9


def test_summaries(spark):
    a = artifacts(spark, [row("human", "question", summary="the cache is slow"), row("human", "critique", summary="no"), row("model", "question", summary="the cache is slow"), row("model", "critique", summary="  ")])
    r = summary_metrics.per_issue(a).first()
    assert (r.human_types, r.model_types, r.matched_types, r.type_recall, r.token_f1, r.penalised_token_f1) == (2, 1, 1, 0.5, 1.0, 0.5)


def test_leaderboard(spark):
    names = [f"c{k}" for k in range(7)]
    c = spark.createDataFrame([("r", m, n, v) for n in names for m, v in (("A", 0.9), ("B", 0.1))], "repository string, model_id string, component string, value double")
    a, b = leaderboard.per_repository(c).orderBy("rank").collect()
    assert (a.model_id, a.points, b.points, b.points_to_leader) == ("A", 100, 98, 2) and abs(a.score - 7 / 61) < 1e-12 and abs(b.score - 7 / 62) < 1e-12
    assert [r.repo_count for r in leaderboard.combined(c).collect()] == [1, 1]


def test_boards_with_metadata(spark, tmp_path):
    from threadloom.plans import metric_queries as Q

    one = lambda k, side, model, tags, area, summary: (k, side, model, "r", 1, 0, k, None, "question", summary, tags, {"target_area": area}, "x")
    rows = [one(1, "human", None, ["a"], "cache", "slow cache"), one(2, "model", "A", ["b"], "cache", "zzz"), one(3, "model", "B", ["a"], "disk", "slow cache")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "artifact.parquet"))
    d = str(tmp_path)
    soft = _similar("cache", "disk")
    want = {"A": {"type_f1": 1, "metadata_f1": 1, "metadata_soft_f1": 1, "tag_f1": 0, "summary_token_f1": 0}, "B": {"type_f1": 1, "metadata_f1": 0, "metadata_soft_f1": soft, "tag_f1": 1, "summary_token_f1": 1}}
    for f in (Q.leaderboard_components_with_metadata, Q.complete_components_with_metadata):
        got = {(r.model_id, r.component): r.value for r in f(spark, d).collect()}
        assert set(got) == {(m, c) for m in want for c in want[m]} and all(abs(got[m, c] - v) < 1e-5 for m in want for c, v in want[m].items())
    board = {r.model_id: r for r in Q.leaderboard_rrf_with_metadata(spark, d).collect()}
    assert board["A"]["rank"] == 1 and all(abs(board[m].score - s) < 1e-5 and abs(board[m].max_score - 5 / 61) < 1e-5 for m, s in (("A", 3 / 61 + 2 / 62), ("B", 2 / 61 + 3 / 62)))
    points = {r.model_id: (round(r.composite, 5), r.points) for r in Q.profile_points_with_metadata(spark, d).collect()}
    assert points == {m: (round(sum(v.values()) / 7, 5), round(sum(v.values()) / 7 * 100)) for m, v in want.items()}


@pytest.mark.parametrize(("raw", "want"), [(-0.73, 0.409750), (0.21, 0.526226)])
def test_logistic(spark, raw, want):
    r = spark.range(1).select(X.logistic_score(F.lit(raw)).alias("s"), X.logistic_score(F.lit(raw), "clip").alias("c")).first()
    assert round(r.s, 6) == want and r.c == max(raw, 0)


def test_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(X.quantise("x", 1, 100)).collect()] == [0, 2, 2]


def test_empty_table(spark):
    a = align.aligned(spark.createDataFrame([], SCHEMA))
    assert type_metrics.per_issue(type_metrics.type_flags(a)).count() == 0
    assert metadata_metrics.per_issue(a).count() == 0
    assert summary_metrics.per_issue(a).count() == 0


def table(spark, rows):
    """rows: (id, side, model, repository, issue, type, tags)."""
    return spark.createDataFrame([(k, side, m, r, i, 0, k or 0, None, t, "s", tags, None, "x") for k, side, m, r, i, t, tags in rows], SCHEMA)


def test_several_models_and_repositories(spark):
    """Human artifacts meet every model of their repository and no other; sets made distinct beforehand give the same scores."""
    rng = random.Random(4)
    rows, k = [], 0
    for r, models in (("r", ("A", "B")), ("s", ("B", "C")), ("t", ())):
        for issue in range(6):
            for m in (None, *models):
                for _ in range(rng.randrange(0, 4)):
                    k += 1
                    rows.append((k, "model" if m else "human", m, r, issue, rng.choice(["x", "y", "Y", " x "]), rng.sample(["a", "b", "A", ""], rng.randrange(0, 3))))
    df = table(spark, rows)
    wide, narrow = align.aligned(df), align.type_sets(df)
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)
    assert same(type_metrics.per_type(type_metrics.type_flags(wide)), type_metrics.per_type(type_metrics.type_flags(narrow)))
    assert same(tag_metrics.pooled(tag_metrics.tag_counts(wide)), tag_metrics.pooled(tag_metrics.tag_counts(align.tag_sets(df))))
    got = {(r.model_id, r.repository, r.issue_number): (r.intersection_count, r.human_count, r.model_count) for r in type_metrics.per_issue(type_metrics.type_flags(narrow)).collect()}
    want = {}
    for m, r in {(x[2], x[3]) for x in rows if x[2]}:
        for issue in range(6):
            h, l = ({x[5].strip() for x in rows if (x[2], x[3], x[4]) == (who, r, issue)} for who in (None, m))
            if h or l:
                want[m, r, issue] = (len(h & l), len(h), len(l))
    assert got == want


def test_names_are_compared_as_they_stand(spark):
    df = table(spark, [(1, "human", None, "r", 1, "Bug-Fix ", ["Slow UI"]), (2, "model", "m", "r", 1, "bug_fix", ["slow_ui"])])
    f1 = lambda normal: type_metrics.macro(type_metrics.per_issue(type_metrics.type_flags(align.type_sets(df, normal)))).first().f1
    assert (f1(False), f1(True)) == (0, 1)
    assert {r.tag for r in align.tag_sets(df).collect()} == {"", "Slow UI", "slow_ui"}


def test_issues_without_artifacts_count(spark):
    """A side that was asked and found nothing is an empty set: 1 where the other is empty too, else 0."""
    rows = [(1, "human", None, "r", 1, "x", ["a"]), (2, "model", "m", "r", 1, "x", ["a"]), (None, "human", None, "r", 2, None, None), (None, "model", "m", "r", 2, None, None), (3, "human", None, "r", 3, "x", []), (None, "model", "m", "r", 3, None, None)]
    df = table(spark, rows)
    by = {r.issue_number: (r.human_count, r.model_count, r.f1) for r in type_metrics.per_issue(type_metrics.type_flags(align.type_sets(df))).collect()}
    assert by == {1: (1, 1, 1.0), 2: (0, 0, 1.0), 3: (1, 0, 0.0)}
    assert [(r.type, r.tp, r.fn, r.tn) for r in type_metrics.per_type(type_metrics.type_flags(align.type_sets(df))).collect()] == [("x", 1, 1, 1)]
    assert tag_metrics.macro(tag_metrics.tag_counts(align.tag_sets(df))).first().issue_count == 3
    assert {r.type for r in tag_metrics.pooled(tag_metrics.tag_counts(align.tag_sets(df))).where("level = 'type'").collect()} == {"x"}


@pytest.mark.parametrize("n", [1, 6, 7, 13, 20, 23])
def test_ring(spark, n):
    from threadloom.operators import reports

    rng = random.Random(n)
    score = {f"t{k:02}": rng.choice((0.1, 0.2, 0.5, 0.9)) for k in range(n)}
    names = sorted(score, key=lambda t: (score[t], t))
    if n > 6:
        size = -(-n // (5 if n >= 20 else 4))
        lanes, woven = [names[k : k + size] for k in range(0, n, size)], []
        for k in range(size):
            line = [lane[k] for lane in lanes if k < len(lane)]
            woven += line[::-1] if k % 2 else line
        names = woven
    df = spark.createDataFrame([("m", t, s) for t, s in score.items()], "model_id string, type string, f1 double")
    assert [r.type for r in reports.spread(df, "f1").orderBy("place").collect()] == names


def test_components_must_be_finite(spark):
    df = spark.createDataFrame([("r", "a", 1.0), ("r", "b", float("inf")), ("r", "c", float("-inf")), ("r", "d", float("nan")), ("r", "e", None)], "repository string, model_id string, f1 double")
    assert [r.model_id for r in leaderboard.unpivot([("x", df, "f1")]).collect()] == ["a"]


def brute_match(h, m, similar, threshold):
    pairs = sorted(((-similar(a, b), i, j) for i, a in enumerate(h) for j, b in enumerate(m)), key=lambda p: p)
    hs, ms, tp = set(), set(), 0
    for s, i, j in pairs:
        if i not in hs and j not in ms:
            hs.add(i)
            ms.add(j)
            tp += -s >= threshold
    return tp


SIMILAR = {
    "max_all": lambda a, b: _similar(a, b),
    "token_f1": lambda a, b: 2 * len(set(a.split()) & set(b.split())) / (len(set(a.split())) + len(set(b.split()))),
    "token_jaccard": lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split())),
    "token_containment": lambda a, b: len(set(a.split()) & set(b.split())) / min(len(set(a.split())), len(set(b.split()))),
    "sequence_ratio": lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(),
    "char_ngram_jaccard": lambda a, b: len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b)),
}


def _grams(s):
    return {(" " + s + " ")[i : i + 3] for i in range(len(s))}


def test_all_methods_and_levels_against_brute_force(spark):
    """Groups over a whole repository and per issue, many equal values, several near phrases; every similarity."""
    rng = random.Random(11)
    words = ["unknown", "unknown", "unknown", "unknown cache", "cache unknown", "cache", "parser", "slow parser", "parser slow", "disk", "disks", "cash"]
    rows = [row(side, kind, meta={"target_area": rng.choice(words)}, issue=issue) for issue in range(6) for side in ("human", "model") for kind in ("x", "y") for _ in range(rng.randrange(0, 7))]
    a = artifacts(spark, rows)
    held = lambda side, issues, kind: [x[4]["target_area"] for x in sorted(rows, key=lambda x: x[1]) if x[0] == side and x[1] in issues and x[2] == kind]
    for level, group in (("issue", metadata_metrics.GROUP), ("all", ("model_id", "repository", "type", "field"))):
        matching = metadata_metrics.Matching(metadata_metrics.field_values(a), metadata_metrics.METHODS, group)
        for method in metadata_metrics.METHODS:
            for r in matching.scores(method, 0.7).collect():
                h, m = (held(side, {r.issue_number} if level == "issue" else range(6), r.type) for side in ("human", "model"))
                assert (r.human_count, r.model_count) == (len(h), len(m))
                assert r.tp == brute_match(h, m, SIMILAR[method], 0.7), (level, method, r)
                if h and m:
                    assert abs(r.sum_best_human - sum(max(SIMILAR[method](x, y) for y in m) for x in h)) < 1e-9
                    assert abs(r.sum_best_model - sum(max(SIMILAR[method](x, y) for y in h) for x in m)) < 1e-9


def test_very_many_equal_values_are_counted_not_paired(spark):
    """300,000 equal values on each side of one group: their pairs would be 9e10."""
    n = 300_000
    v = spark.range(2 * n).select(F.lit("m").alias("model_id"), F.lit("r").alias("repository"), F.col("id").alias("issue_number"), F.lit("x").alias("type"), F.lit("f").alias("field"), (F.col("id") % 2).cast("int").alias("h"), F.lit(0).alias("comment_idx"), F.lit(0).alias("artifact_idx"), F.col("id").alias("artifact_id"), F.when(F.col("id") < 2, "other").otherwise("unknown").alias("phrase"))
    r = metadata_metrics.group_scores(v, group=("model_id", "repository", "type", "field")).first()
    assert (r.human_count, r.model_count, r.tp, r.sum_best_human) == (n, n, n, n)


def test_long_summaries_are_scored_in_one_pass(spark):
    """A text of 600,000 characters; reading it from the start for each of its trigrams took minutes."""
    import time

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh12", k=rng.randrange(1, 9))) for _ in range(3000)]
    x, y = (" ".join(rng.choices(words[lo : lo + 2000], k=110_000)) for lo in (0, 1000))
    df = spark.createDataFrame([(x, y), ("a", "A!"), ("", "?"), ("b", "")], "a string, b string")
    began = time.time()
    got = [r.s for r in df.select(summary_metrics.lexical(F.col("a"), F.col("b")).alias("s")).collect()]
    assert time.time() - began < 30
    grams = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    a, b = set(x.split()), set(y.split())
    f1, tri = 2 * len(a & b) / (len(a) + len(b)), len(grams(f" {x} ") & grams(f" {y} ")) / len(grams(f" {x} ") | grams(f" {y} "))
    assert abs(got[0].token_f1 - f1) < 1e-12 and abs(got[0].trigram - tri) < 1e-12 and tri < 1
    assert [(s.token_f1, s.trigram) for s in got[1:]] == [(1, 1), (1, 1), (0, 0)]
