"""Whole runs over a folder, by the command line and in parts."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom import cli
from threadloom.operators import backends, prompting, reports, retrieve, summary_metrics
from threadloom.pipeline import Workspace
from threadloom.sources import files


def issue(n, title, *comments):
    return {"number": n, "title": title, "body": f"The parser in src/p{n}.py fails.", "state": "OPEN", "createdAt": f"2021-01-0{n}T00:00:00Z", "author": {"login": "ann"}, "labels": [{"name": "bug"}], "comments": [{"id": f"{n}-{k}", "body": c, "createdAt": f"2021-02-0{k + 1}T00:00:00Z", "author": {"login": "bob"}} for k, c in enumerate(comments)], "timelineItems": []}


ISSUES = [issue(1, "Parser crash", "Why does it crash?", "Fixed in the next release."), issue(2, "Slow load", "It is slow when the cache is cold."), issue(3, "Docs", "thanks")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    raw, human, code = (root / x for x in ("in", "human", "code"))
    for d in (raw, human, code / "src"):
        d.mkdir(parents=True)
    for i in ISSUES:
        (raw / f"issue_{i['number']}.json").write_text(json.dumps(i))
        kind = "question" if i["number"] == 1 else "status_update"
        (human / f"issue_{i['number']}.json").write_text(json.dumps({"issue": {"issue_number": i["number"], "comments": [{"artifacts": [{"type": kind, "summary": "It crashes in the parser", "tags": ["bug"], "metadata": {"status_kind": "mention"}}] if i["number"] < 3 else []}]}}))
    (code / "src" / "p1.py").write_text("def parser(x):\n    return x\n\n\nclass Crash:\n    pass\n")
    (code / "src" / "note.txt").write_text("no source")
    return root


def test_run_by_commands(spark, folder, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    w = Workspace(spark, str(folder / "ws"))
    go = lambda *a: cli.main([a[0], "--workspace", w.root, *a[1:]])
    with pytest.raises(FileNotFoundError, match="raw_issue"):
        go("curate-repo")
    assert go("load-repo", "--source", str(folder / "in"), "--repository", "o/r") == 0
    assert go("load-repo", "--source", str(folder / "in"), "--repository", "o/s") == 0
    assert go("load-repo", "--source", str(folder / "in"), "--repository", "o/r") == 0  # again: replaced, not doubled
    assert w.read("raw_issue").count() == 6
    assert go("curate-repo", "--min-comments", "1") == 0 and w.read("curated").count() == 6
    assert go("extract-discussion-artifacts-regex", "--limit", "2") == 0
    assert {r.issue_number for r in w.read("rule_artifact").select("issue_number").distinct().collect()} <= {1, 2}
    for repository in ("o/r", "o/s"):
        assert go("load-extraction", "--source", str(folder / "human"), "--repository", repository) == 0
    assert w.read("artifact").where("side = 'human' and artifact_id is null").count() == 2  # issue 3 of both: nothing found
    assert go("extract-discussion-artifacts", "--model", "stub/1") == 0
    assert go("extract-discussion-artifacts", "--model", "stub/1") == 0
    model = w.read("artifact").where("side = 'model'")
    assert {(r.issue_number, r.type) for r in model.where("repository = 'o/r' and type is not null").collect()} == {(1, "question"), (1, "status_update"), (2, "status_update"), (3, "status_update")}
    assert go("retrieve-code-chunks", "--source", str(folder / "code"), "--repository", "o/r") == 0
    assert {r.symbol_name for r in w.read("chunk").collect()} == {"parser", "Crash"}
    for suffix in ("", "-no-context", "-few-shot"):
        assert go("generate-issue-thoughts" + suffix, "--model", "answerer") == 0
        r = {(x.repository, x.issue_number): x for x in w.read("response").collect()}
        assert len(r) == 6 and "[Question] Is this still open?" in r["o/r", 1].response
        shown = r["o/r", 1].prompt
        assert ("def parser" in shown) == (suffix == "") and ("Example 1" in shown) == (suffix == "-few-shot")
        assert "def parser" not in r["o/s", 1].prompt
    assert go("extract-derived-artifacts") == 0
    assert w.read("artifact").where("model_id = 'answerer'").count() == 12
    assert go("compute-all-metrics") == 0
    macro = {(r.model_id, r.repository): r for r in w.read("metrics/type_macro").collect()}
    assert set(macro) == {(m, r) for m in ("stub/1", "answerer") for r in ("o/r", "o/s")} and macro["stub/1", "o/r"].issue_count == 3
    # issues: {question} of two types, the same one, and one where people found nothing
    assert abs(macro["stub/1", "o/r"].f1 - (2 / 3 + 1 + 0) / 3) < 1e-9
    assert go("build-leaderboard") == 0
    board = w.read("leaderboard").orderBy("rank").collect()
    assert len(board) == 2 and board[0].points >= board[1].points and board[0].repo_count == 2
    assert go("compute-extraction-comparison") == 0 and w.read("comparison/issue").count() > 0
    assert go("visualize-metrics") == 0 and go("view") == 0
    assert "component_heatmap" in w.figures() and (folder / "ws" / "viewer.html").read_text().startswith("<!doctype html>")
    assert (folder / "ws" / "figures" / "type_ring.html").exists()
    manifest = spark.read.json(w.root + "/_manifests/curated").first()
    assert (manifest.row_count, manifest.min_comments) == (6, "1")


def test_errors_of_one_metric_do_not_stop_the_others(spark, folder, monkeypatch):
    w = Workspace(spark, str(folder / "ws2"))
    w.load_extraction(str(folder / "human"), "o/r", "human")
    w.load_extraction(str(folder / "human"), "o/r", "model", "m")
    failed = w.score(("type", "metadata"), method="no such")
    assert set(failed) == {"metadata"} and w.read("metrics/type_macro").first().f1 == 1


def test_a_model_that_fails_or_says_something_else(spark):
    def make():
        def call(prompt):
            if "boom" in prompt:
                raise TimeoutError("late")
            if "odd" in prompt:
                return "no json"
            return json.dumps({"artifacts": [{"type": "question", "summary": " s ", "tags": ["Bug-Fix", 3], "metadata": {"a": [1, None, "x"], "b": {"k": True}}}, {"type": "none", "summary": "s"}, "x"]})

        return call

    jobs = spark.createDataFrame([("r", 1, k, "a", "l", t) for k, t in enumerate(("boom", "odd", "fine"))], "repository string, issue_number long, comment_idx int, author string, link string, text string")
    rows = {r.comment_idx: r for r in backends.model_artifacts(jobs, make).collect()}
    assert (rows[0].status, rows[0].error_type, rows[0].type) == ("error", "TimeoutError", None) and rows[1].error_type == "ValidationError"
    assert (rows[2].status, rows[2].type, rows[2].tags) == ("ok", "question", ["incorrect_behavior"]) and "unknown" in rows[2].metadata.values()
    got = backends.run_counts(backends.model_artifacts(jobs, make), "issue_number").first()
    assert (got.total_comments, got.failed_comments, got.artifact_count) == (3, 2, 1)
    assert backends.metadata_text({"b": {"k": True}, "a": [1, None, "x"], "c": None}) == "a: 1 x ; b: k: True"
    with pytest.raises(ValueError, match="module:function"):
        backends.runner("nothing")


def test_reports_of_earlier_runs(spark, tmp_path):
    d = tmp_path / "gpt-9" / "o__r"
    d.mkdir(parents=True)
    (d / "type_matching.json").write_text(json.dumps({"macro_average": {"f1": 0.5}}))
    (d / "tag_matching.json").write_text('{"overall": {"f1": NaN}}')
    (d / "metadata_matching.json").write_text(json.dumps({"macro_average": {"f1": "0.25", "soft_f1": "x"}}))
    got = {(r.repository, r.model_id, r.component): r.value for r in files.report_components(spark, str(tmp_path)).collect()}
    assert got == {("o/r", "gpt-9", "type_f1"): 0.5, ("o/r", "gpt-9", "metadata_f1"): 0.25}
    assert files.report_components(spark, str(tmp_path), complete=True).count() == 0
    (d / "summary_matching.json").write_text(json.dumps({"overall": {"all_issues_macro_with_unmatched_penalty": {"codebert": {"cosine": 1}, "bleurt": {"score": None}}}}))
    assert {r.component for r in files.report_components(spark, str(tmp_path), complete=True).collect()} == {"type_f1", "metadata_f1", "summary_codebert"}
    assert files.report_components(spark, str(tmp_path / "none")).count() == 0
    j = spark.createDataFrame([('{"a": {"b": 1}}',), ("x",), ('{"a": 2}',), (None,)], "j string")
    assert [r[0] for r in j.select(files.at_path("j", "a", "b")).collect()] == ["1", None, None, None]


def test_stage_files(spark, tmp_path):
    df = spark.createDataFrame([(2, "x"), (1, "y")], "b long, a string")
    files.write_json(df.coalesce(1), str(tmp_path / "j"))
    (part,) = (tmp_path / "j").glob("*.json")
    assert part.read_text().splitlines() == ['{"a":"x","b":2}', '{"a":"y","b":1}']
    (tmp_path / "l.jsonl").write_text('{"b": 1}\n\n{"b": 2}\n')
    assert sorted(r.b for r in files.read_lines(spark, str(tmp_path / "l.jsonl"), "b long").collect()) == [1, 2]
    assert files.manifest(df, model="m").first().asDict() == {"row_count": 2, "model": "m"}
    inner = tmp_path / "code" / "code"
    inner.mkdir(parents=True)
    (inner / "a.py").write_bytes(b"x = '\xff'")
    (inner / "b.txt").write_text("no")
    got = files.snapshot_files(spark, str(tmp_path / "code"), ("py",)).collect()
    assert [(r.file_path, r.text) for r in got] == [("code/a.py", "x = '\ufffd'")]


def test_index_is_kept_and_found_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat"), (2, "a dog"), (3, None)], "id long, t string")
    f = str(tmp_path / "ix")
    assert retrieve.load_index(spark, f, "id", "t") is None
    first = retrieve.ensure_index(docs, f, "id", "t")
    again = retrieve.ensure_index(docs.where("false"), f, "id", "t")  # not built anew
    assert first["documents"].count() == again["documents"].count() == 3 and retrieve.load_index(spark, f, "id", "other") is None
    hit = retrieve.bm25_over(again["postings"], 3, spark.createDataFrame([(9, "cat")], "q long, t string"), "id", "q", "t", 5).collect()
    assert [(r.query_id, r.doc) for r in hit] == [(9, 1)]
    length = {r.id: sum(x * x for x in r.embedding) for r in again["vectors"].collect()}
    assert abs(length[1] - 1) < 1e-9 and length[3] == 0


def test_dense_in_blocks_of_queries(spark):
    import random

    rng = random.Random(5)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(4)]) for k in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(5)
    q = df.where("id % 10 = 0")
    want = {}
    for a, x in rows[:300:10]:
        order = sorted(rows[:300], key=lambda r, x=x: (-sum(p * y for p, y in zip(x, r[1], strict=True)), r[0]))
        want |= {(a, r[0]): n + 1 for n, r in enumerate(order[:7])}
    for most in (64_000_000, 200):
        got = {(r.query_id, r.doc): r["rank"] for r in retrieve.dense(df, q, "id", "v", 7, most).collect()}
        assert got == want
    assert retrieve.dense(df, q.where("false"), "id", "v", 7).count() == 0


def test_vector_scores():
    import numpy as np
    import pandas as pd

    a, b = [[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0], None]
    got = summary_metrics.vector_scores(pd.Series([a, None, [], a]), pd.Series([b, None, a, a]))
    assert got.iloc[0].tolist()[:3] == [1.0, 0.5, 2 / 3] and abs(got.iloc[0].cosine - np.sqrt(0.5)) < 1e-9
    assert got.iloc[1].tolist() == [1.0] * 4 and got.iloc[2].tolist() == [0.0] * 4 and np.allclose(got.iloc[3], 1)


def test_empty_texts_and_missing_models(spark):
    df = spark.createDataFrame([("", " "), ("x", None), ("x", "y")], "a string, b string")
    score = summary_metrics.with_empty_texts(lambda a, b: F.struct(F.lit(0.5).alias("score")), ("score",))
    assert [r[0].score for r in df.select(score(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]
    assert df.select(summary_metrics.unavailable(F.col("a"), F.col("b")).alias("s")).first().s.asDict() == {"score": 0.0, "unavailable": 1.0}


def test_model_names(spark):
    names = ["gpt-5.4", "openai/gpt-5", "us.anthropic.claude-opus-4-6-v1", "claude-3-haiku", "gemini-2.5-flash", "qwen2.5:7b-instruct", " my__llm/api-x ", "7b.gpt4"]
    df = spark.createDataFrame([(n,) for n in names], "m string")
    got = [(r.f.family, r.f.recency, r.d) for r in df.select(prompting.model_family("m").alias("f"), prompting.display_name("m").alias("d")).collect()]
    assert got == [("gpt", 5.4, "OpenAI GPT-5.4"), ("gpt", 5.0, "OpenAI GPT-5"), ("claude", 304.0, "Claude Opus 4.6"), ("claude", 103.0, "Claude 3 Haiku"), ("gemini", 2.5, "Gemini 2.5 Flash"), ("qwen", 2.5, "Qwen 2.5 7B Instruct"), ("other", 0.0, "My LLM API X"), ("gpt", 4.0, "7b.gpt4")]


def test_pages_say_what_they_leave_out(spark):
    page = reports.page(spark.range(7).toDF("n"), "t", 3)
    assert "the first 3 of 7 rows" in page and page.count('"n"') == 3
    assert "rows)" not in reports.page(spark.range(3).toDF("n"), "t", 3)


def test_scatter_is_as_long_as_the_shorter(spark):
    s = lambda xs: reports.issue_series(spark.createDataFrame([("m", "r", n, x) for n, x in xs], "model_id string, repository string, issue_number long, f1 double"), "f1")
    got = reports.scatter(s([(3, 0.3), (1, 0.1), (2, None)]), s([(1, 0.5), (9, 0.9), (5, 0.7)])).orderBy("place").collect()
    assert [(r.place, r.x, r.y) for r in got] == [(0, 0.1, 0.5), (1, 0.3, 0.7)]


def test_cost_of_an_issue(spark):
    df = spark.createDataFrame([("a", 2.0, 4), ("b", 1.0, 0)], "model_id string, total double, requests long")
    assert [(r.model_id, r.cost_per_issue) for r in reports.cost_per_issue(df).collect()] == [("a", 0.5), ("b", None)]
