import ast
import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import backends, code_chunks, compare, curate, extract, prompting, reports, retrieve
from threadloom.sources import files, forge
from threadloom.streaming import live


def raw(spark, **fields):
    one = {"snapshot_id": 1, "repository": "o/r", "number": 7, "url": "u", "title": "Title", "body": "Body in src/a.py and b.yaml.", "state": "OPEN", "createdAt": "2021-01-01T00:00:00Z", "author": {"login": "reporter"}, "authorAssociation": "NONE", **fields}
    return spark.read.schema(live.STREAM_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(one)]))


def test_curate(spark):
    comments = [{"id": "2", "body": "later src/a.py", "createdAt": "2021-01-03", "author": None, "authorAssociation": "MEMBER"}, None, {"id": "1", "body": " first\n post ", "createdAt": "2021-01-02", "author": {"login": "maintainer"}, "authorAssociation": "MEMBER"}, {"id": "1", "body": "again", "createdAt": "2021-01-04"}]
    items = [{"__typename": "CrossReferencedEvent", "createdAt": "b", "source": {"__typename": "PullRequest", "number": 9, "merged": True}}, {"__typename": "LabeledEvent", "createdAt": "a", "label": {"name": "x"}}, None]
    r = curate.curate(raw(spark, comments=comments, timelineItems=items, labels=[{"name": "b"}, None, {"name": "a"}, {"name": "b"}, {"name": ""}]), distinct=True).first()
    assert r.formatted_discussion == "reporter (external):Title Body in src/a.py and b.yaml.\nmaintainer (member):first post\nunknown (member):later src/a.py"
    assert r.files == ["src/a.py", "b.yaml"] and r.taxonomic_metadata.labels == ["a", "b"]
    assert [e.event_type for e in r.timeline_events] == ["LabeledEvent", "CrossReferencedEvent"]
    assert [p.number for p in r.resolution_artifacts.linked_pull_requests] == [9]


def test_curate_of_nothing(spark):
    df = curate.curate(raw(spark, title=None, body=None, author=None, comments=None, timelineItems=None, labels=None))
    r = df.first()
    assert (r.formatted_discussion, r.deliberation_thread, r.files, r.timeline_events, r.taxonomic_metadata.labels) == ("", [], [], [], [])
    s = curate.summarize(df).first()
    assert (s.record_count, s.records_with_comments) == (1, 0)


def test_files(spark):
    texts = ["The tests fail in src/parser/main.py when I edit config.yaml.", "See tests/test_parser.py.", "https://host/x/y.html and main.py"]
    df = spark.createDataFrame([(texts,)], "t array<string>").select(curate.files(F.col("t")).alias("f"))
    assert df.first().f[:3] == ["src/parser/main.py", "config.yaml", "tests/test_parser.py"] and "main.py" not in df.first().f


def found(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return [(a.type, a.summary, a.tags, a.metadata) for a in extract.with_artifacts(df).first().artifacts]


def test_rules(spark):
    got = found(spark, "Can we fix the crash? I suggest a workaround. cc @me\n```py\nprint('error')\n```")
    assert [a[0] for a in got] == ["code_snippet", "question", "proposed_solution", "task_assignment", "problem_statement"]
    assert got[0][3]["language"] == "py" and got[0][3]["snippet_kind"] == "log" and got[3][3]["assignee"] == "@me"
    assert "crash" in got[1][2] and "workaround" in got[1][2]
    assert found(spark, "  \n ") == [] and found(spark, None) == []
    (only,) = found(spark, "Nothing to see\nhere")
    assert only[:2] == ("status_update", "Nothing to see") and only[3]["status_kind"] == "mention" and only[2] == ["incorrect_behavior"]
    assert len(found(spark, "error " * 100)[0][1]) == 220


def test_fusion_and_windows(spark):
    lists = [spark.createDataFrame([(1, d, k + 1) for k, d in enumerate(x)], "query_id int, doc int, rank int") for x in ([2, 1, 0], [1, 2, 3])]
    got = retrieve.fuse(lists, 60, 3).orderBy("rank").collect()
    assert [r.doc for r in got] == [2, 1, 0] and [round(r.rrf_score, 7) for r in got] == [0.0325225, 0.0325225, 0.0158730]
    df = spark.createDataFrame([(1, "\n".join("abcdefg")), (2, ""), (3, None), (4, "x")], "k int, t string")
    w = {(r.k, r.start_line, r.end_line) for r in retrieve.line_windows(df, "k", "t", 3, 1).collect()}
    assert w == {(1, 1, 3), (1, 3, 5), (1, 5, 7), (4, 1, 1)}


def test_budget(spark):
    c = spark.createDataFrame([(1, f"c{k + 1}", "x" * n) for k, n in enumerate((120, 30, 20, 40, 0))], "g int, id string, t string")
    assert [r.id for r in retrieve.shortest_context(c, ["g"], "id", "t", 10, 55).orderBy("place").collect()] == ["c3", "c2"]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "cache miss cache"), (2, "disk full"), (3, None), (4, "the cache_line 42")], "id int, t string")
    top = retrieve.bm25(docs, docs.where("id = 1"), "id", "id", "t", 5).orderBy("rank").collect()
    assert top[0].doc == 1 and all(r.doc in (1, 2, 4) for r in top)


def test_issues_meet_the_chunks_of_their_repository(spark):
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(5)
    words = ["cache", "parser", "disk", "x_1", "42", "the", "the", "the", "a"]
    chunks = [(r, n, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for n, r in enumerate(rng.choices("pqs", [20, 9, 1], k=90))]
    issues = [(r, i, rng.choice(words), " ".join(rng.choices(words, k=4))) for r in "pqst" for i in range(12)] + [("p", 50, None, " "), ("q", 51, "zzz", None)]
    c = spark.createDataFrame([*chunks, (None, 999, "cache")], "repository string, chunk_no long, text string")
    q = spark.createDataFrame(issues, "repository string, issue_number int, title string, body string")
    tokens = lambda t: re.findall(r"[A-Za-z_][A-Za-z0-9_]+|\d+", t)
    want = {}
    for r, i, title, body in issues:
        own = {n: tokens(t) for s, n, t in chunks if s == r}
        df = Counter(t for x in own.values() for t in set(x))
        idf = {t: math.log(len(own) - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
        low = 0.25 * sum(idf.values()) / max(1, len(idf))
        idf = {t: low if w < 0 else w for t, w in idf.items()}
        mean = sum(map(len, own.values())) / max(1, len(own)) or 1
        score = {n: round(sum(idf.get(t, 0) * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for t in tokens(f"{title or ''} {body or ''}")), 9) for n, x in own.items()}
        for rank, n in enumerate(sorted(score, key=lambda n: (-score[n], n))[:6], 1):
            want[r, i, rank] = (n, score[n])
    named = q.withColumn("query_id", F.struct("repository", "issue_number")).withColumn("text", F.concat_ws(" ", "title", "body"))
    for tile in ((4096, 512), (7, 5)):
        got = {(*x.query_id, x["rank"]): (x.doc, x.score) for x in retrieve.bm25_within(c, named, "repository", "chunk_no", "query_id", "text", 6, tile).collect()}
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    one = {(x.repository, x.issue_number, x["rank"]): x.chunk_no for x in retrieve.for_issues(q, c, top_k=6, n=6).collect()}
    assert one == {k: v[0] for k, v in want.items()}
    last = max(n for r, n, _ in chunks if r == "p")
    v = spark.createDataFrame([("p", last, [1.0])], "repository string, chunk_no long, embedding array<float>"), spark.createDataFrame([("p", 50, [1.0])], "repository string, issue_number int, embedding array<float>")
    both = [x.chunk_no for x in retrieve.for_issues(q, c, v, 6, 60, 2).where("repository = 'p' and issue_number = 50").orderBy("rank").collect()]
    assert both == [want["p", 50, 1][0], last]


def test_prompts_hold_the_chunks_of_the_issue(spark, tmp_path):
    from threadloom.plans import discussion_queries as Q

    text = [f"filler {k}" for k in range(25)] + ["def cache_eviction(): return 'the chunk the second issue is about'"]
    spark.createDataFrame([(k, "r", f"c{k:02}", "f.py", None, 1, 2, t) for k, t in enumerate(text)], "chunk_no long, repository string, chunk_id string, file_path string, symbol_name string, start_line int, end_line int, text string").write.parquet(str(tmp_path / "chunk.parquet"))
    spark.sql("select i as record_id, timestamp'2021-01-01' as ingested_at, 'r' as repository, i as issue_number, named_struct('title', if(i = 1L, 'filler', 'cache_eviction'), 'body', cast(null as string)) as input_vector from values (1L), (2L) as t(i)").write.parquet(str(tmp_path / "curated.parquet"))
    found = {(x.issue_number, x["rank"]): x.chunk_no for x in Q.issue_context(spark, str(tmp_path)).collect()}
    assert len(found) == 40 and found[2, 1] == 25 and 25 not in [c for (i, _), c in found.items() if i == 1]
    assert {x.context_chunks for x in Q.issue_prompts(spark, str(tmp_path)).collect()} == {10}


def test_symbols():
    text = "import os\n\ndef a():\n    return 1\n\nclass B:\n    def c(self):\n        pass\n"
    assert [(c[2], c[4], c[5]) for c in code_chunks.chunk_file("x.py", text)] == [("a", 3, 4), ("B", 6, 8), ("c", 7, 8)]
    assert [c[2] for c in code_chunks.chunk_file("x.go", "package a\n\nfunc F() {\n}\n\nfunc (t T) G(x int) {\n}\n")] == ["F", "G"]
    assert [(c[4], c[5]) for c in code_chunks.chunk_file("x.txt", "\n".join("abcdefg"), 3, 1)] == [(1, 3), (3, 5), (5, 7)]
    assert code_chunks.chunk_file("x.py", None) == code_chunks.chunk_file("x.py", " \n") == []
    assert ast.parse(text)


def test_prompts(spark):
    issues = spark.createDataFrame([(1, 5, "T", "B"), (2, 6, "T", "B" * 5000)], "k int, number long, title string, body string")
    chunks = spark.createDataFrame([(1, "a", "f.py", "s", 1, 2, "x" * 50), (1, "b", "g.py", None, 1, 2, "y" * 900), (1, "c", "h.py", None, 1, 2, "  "), (2, "d", "h.py", None, 1, 2, "z")], "k int, chunk_id string, file_path string, symbol_name string, start_line int, end_line int, text string")
    got = {r.k: r for r in prompting.prompts_within(issues, chunks, ["k"], 1500, 10).collect()}
    base = len(prompting.INTRO) + len("\n\nIssue #5: T\nB\n\nCode context:\n[f.py:1-2 (s)]\n" + "x" * 50 + "\n")
    assert got[1].context_chunks >= 2 and "[f.py:1-2 (s)]\n" + "x" * 50 in got[1].prompt and len(got[1].prompt) in (base, base + 2 + len("[g.py:1-2]\n") + 900)
    assert got[2].context_chunks == 0 and got[2].prompt.endswith("Code context omitted by configuration.\n")


def test_split_and_routes(spark):
    df = spark.createDataFrame([("intro [Problem Statement] A is broken [Proposed Solution] Add b",), ("plain",), (" ",), (None,)], "t string")
    got = [r[0] for r in df.select(prompting.split_response("t")).collect()]
    assert got == [["[Problem Statement] A is broken", "[Proposed Solution] Add b"], ["plain"], [], []]
    ids = ["api/x", "openai/y", "ollama/z:1b", "qwen2.5:14b", "a:latest", "claude-v1:0", "plain"]
    p = [tuple(r.p) for r in spark.createDataFrame([(i,) for i in ids], "m string").select(prompting.provider("m").alias("p")).collect()]
    assert p == [("api", "x"), ("api", "y"), ("ollama", "z:1b"), ("ollama", "qwen2.5:14b"), ("ollama", "a:latest"), ("api", "claude-v1:0"), ("api", "plain")]


def test_self_is_no_example(spark):
    e = spark.createDataFrame([("r", n) for n in range(5)], "repository string, issue_number int")
    got = retrieve.exclude_self(e, e, ["issue_number"], ["issue_number"], 2).collect()
    assert {(r.issue_number, r.example_issue_number) for r in got if r.issue_number == 0} == {(0, 1), (0, 2)} and len(got) == 10


def test_documents_folder(spark, tmp_path):
    a = {"type": "question", "summary": "s", "tags": ["t"], "metadata": {"k": "v"}}
    (tmp_path / "issue_10.json").write_text(json.dumps({"issue": {"issue_number": 0, "comments": [None, {"artifacts": [a, None]}]}}))
    (tmp_path / "issue_2.json").write_text(json.dumps({"issue": {"issue_number": 2, "comments": [{"artifacts": [a]}]}}, indent=2))
    d = files.read_documents(spark, str(tmp_path), files.EXTRACTION)
    (tmp_path / "issue_3.json").write_text(json.dumps({"issue": {"issue_number": 3, "comments": [{"artifacts": []}, None]}}))
    (tmp_path / "issue_4.json").write_text(json.dumps({"issue": {"issue_number": 4}}))
    d = files.read_documents(spark, str(tmp_path), files.EXTRACTION)
    assert {(r.issue_number, r.comment_idx) for r in files.extraction_artifacts(d).collect()} == {(10, 1), (2, 0), (3, None), (4, None)}
    assert files.read_documents(spark, str(tmp_path / "none"), files.EXTRACTION).count() == 0
    path = files.write_stage(files.extraction_artifacts(d), str(tmp_path), "artifacts")
    assert spark.read.parquet(path).count() == 4


def pages(numbers):
    def transport(query, v):
        if query == "issues":
            at = int(v["after"] or 0)
            some = numbers[at : at + v["first"]]
            return {"data": {"repository": {"issues": {"nodes": [{"number": n, "comments": {"totalCount": c}} for n, c in some], "pageInfo": {"hasNextPage": at + v["first"] < len(numbers), "endCursor": str(at + v["first"])}}}}}
        one = {"nodes": [{"id": "1"}, {"id": "1"}, None], "pageInfo": {"hasNextPage": False, "endCursor": None}}
        return {"data": {"repository": {"issue": {"number": v["number"], "comments": one, "timelineItems": one}}}}

    return transport


def test_forge():
    numbers = [(100, 0), (101, 9), (103, 10), (104, 25), (105, 26)]
    assert list(forge.issue_numbers(pages(numbers), "o/r", least=10, most=25, page=2)) == [103, 104]
    assert len(forge.fetch_issue(pages(numbers), "o/r", 103)["comments"]) == 1
    waits, calls = [], []

    def shaky(query, v):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {"data": {"x": 1}}

    assert forge.execute(shaky, "q", {}, sleep=waits.append) == {"x": 1} and waits == [1, 2]
    with pytest.raises(forge.ForgeError):
        forge.execute(lambda q, v: {"errors": ["no"]}, "q", {})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"snapshot_id": 1, "repository": "o/r", "number": 1, "url": "u", "title": "t", "createdAt": "x", "comments": [{"id": "1", "body": "This is a bug", "createdAt": "y"}]}))
    live.run_available(live.artifact_stream(live.raw_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert [r.type for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["problem_statement"]


def test_backends(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")

    def make():
        def call(p):
            if p == "bad":
                raise ValueError("no")
            return p.upper()

        return call

    got = {r.id: (r.response, r.error_type) for r in backends.complete(df, make).collect()}
    assert got == {1: ("GOOD", None), 2: (None, "ValueError")}
    assert backends.parse_artifacts('{"artifacts": [{"type": "question", "summary": "s"}, {"type": "zzz", "summary": "s"}]}')[0] == [{"type": "question", "summary": "s"}]
    assert backends.metadata_text({"b": [1, True, None, ""], "a": None, "c": " x "}) == "b: 1 True ; c: x"


def test_embeddings_and_page(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id long, t string")
    got = {r.id: r.embedding for r in backends.embed(df, lambda: lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts], "id", "t").collect()}
    assert [round(x, 6) for x in got[1]] == [0.6, 0.8] and got[2] == [0, 0]
    html = reports.page(spark.createDataFrame([("</script>", None)], "a string, b int"), "<x>")
    assert html.count("</script>") == 2 and "<\\/script>" in html and "&lt;x>" in html


def test_comment_prompt(spark):
    df = spark.createDataFrame([("o/r", 3, "me", None, 'say "hi"')], "repository string, issue_number long, author string, link string, text string")
    p = df.select(prompting.comment_prompt()).first()[0]
    assert p.startswith('Repo: o/r\nIssue: 3\nComment JSON:\n{"author":"me","link":"","text":"say \\"hi\\""}\nMetadata keys') and "- question: question_kind, target_area, urgency" in p


def test_comparison_has_every_block(spark):
    schema = "repository string, issue_number int, comment_idx int, artifact_idx int, type string, summary string, tags array<string>, metadata map<string,string>"
    one = lambda issue, kind, summary, tags, meta, k=0: ("r", issue, 0, k, kind, summary, tags, meta)
    rules = [one(1, "question", "the cache is slow", ["a", "b"], {"area": "cache", "urgency": "unknown"}), one(2, "question", "x", [], {"area": "disk"}), one(4, "question", " ", ["a"], {})]
    people = [one(1, "question", "the cache is slow", ["a"], {"area": "cache", "kind": "zzz"}), one(3, "question", "y", [], {}), one(4, "question", None, ["a"], {})]
    both = compare.side_by_side(spark.createDataFrame(rules, schema), spark.createDataFrame(people, schema))
    t = compare.per_type(both).first()
    # issue 1: one of two values found; 2: the rules alone, precision 1; 3 and 4: no values
    assert (t.issue_count, t.type_precision, t.tag_precision, t.tag_recall) == (4, 0.75, 0.5, 0.375)
    assert (t.metadata_precision, t.metadata_recall, t.metadata_soft_precision, t.metadata_soft_recall) == (0.875, 0.75, 0.875, 0.75) and abs(t.metadata_f1 - (2 / 3 + 0 + 1 + 1) / 4) < 1e-12
    assert (t.summary_f1, t.summary_trigram) == (0.5, 0.5)
    comments = spark.createDataFrame([("r", 1, 3, 1), ("r", 2, 2, None)], "repository string, issue_number int, reference_comments long, candidate_comments long")
    # without a type of the rules recall is 1, so issues 1, 3 and 4 count as matched
    o = compare.overall(compare.per_issue(both), comments).first()
    assert (o.issue_count, o.reference_comments, o.candidate_comments, o.reference_artifacts, o.candidate_artifacts, o.count_ratio, o.count_delta) == (4, 5, 1, 3, 3, 1.0, 0)
    assert (o.type_precision, o.metadata_soft_recall, o.summary_all_issues, o.summary_matched_only, o.compat_all_issues_with_penalty) == (0.75, 0.75, 0.25, 1 / 3, 0.0)
    assert {r.tag: (r.reference_mentions, r.candidate_mentions) for r in compare.tag_frequency(both).collect()} == {"a": (2, 2), "b": (1, 0)}


def test_bm25_leaves_postings_where_they_are(spark):
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(8)
    for words in (["the", "half", *[f"w{k}" for k in range(300)]], ["aa", "bb"]):
        texts = {n: " ".join(["the"] * (n % 3) + ["half"] * (n % 2) + rng.choices(words, k=rng.randrange(0, 30))) for n in range(120)} | {120: None, 121: "?", 122: "the half"}
        df = spark.createDataFrame([*texts.items()], "id long, t string").repartition(3)
        own = {n: re.findall(r"[A-Za-z_][A-Za-z0-9_]+|\d+", t or "") for n, t in texts.items()}
        count = Counter(t for x in own.values() for t in set(x))
        idf = {t: math.log(len(own) - c + 0.5) - math.log(c + 0.5) for t, c in count.items()}
        low = 0.25 * sum(idf.values()) / len(idf)
        idf = {t: low if w < 0 else w for t, w in idf.items()}
        mean = sum(map(len, own.values())) / len(own)
        want = {}
        for q in range(0, 123, 3):
            score = {n: round(sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for t in own[q]), 9) for n, x in own.items() if set(x) & set(own[q])}
            want |= {(q, rank): (n, score[n]) for rank, n in enumerate(sorted(score, key=lambda n: (-score[n], n))[:7], 1)}
        for most in (retrieve.QUERY_BYTES, 9_000):
            found = retrieve.bm25(df, df.where("id % 3 = 0"), "id", "id", "t", 7, most)
            got = {(r.query_id, r["rank"]): (r.doc, r.score) for r in found.collect()}
            assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-9 for k in want)
            assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert retrieve.bm25(df.limit(0), df, "id", "id", "t").count() == 0 and retrieve.bm25(df, df.limit(0), "id", "id", "t").count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "id int, t string")
    assert retrieve.once(twice, "id").count() == 2 and retrieve.once(twice.dropDuplicates(), "id").count() == 2


def test_hybrid_writes_vectors_of_queries_only(spark, monkeypatch):
    import hashlib

    from threadloom.plans import discussion_queries as Q

    written = []
    monkeypatch.setattr(Q, "cut", lambda df: written.append(df.count()) or df)
    assert Q.hybrid_rrf(spark, "/root/testdata/sf0.001").count() == 20 and sum(written) < 10
    df = spark.createDataFrame([(1, "cat cat the_dog 12"), (2, None), (3, "?")], "id int, t string")
    got = {r.id: r.embedding for r in retrieve.hashed_vectors(df, "id", "t", 64).collect()}
    want = [0.0] * 64
    for t in "cat cat the_dog 12".split():
        want[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 64] += 1
    size = sum(x * x for x in want) ** 0.5
    assert got == {1: [x / size for x in want], 2: [0.0] * 64, 3: [0.0] * 64}


def test_vectors_within_groups_in_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    v = [(g, n, [float(x) for x in rng.integers(-3, 4, 5)]) for n, g in enumerate(rng.choice(["p", "q"], 60).tolist())]
    q = [(g, n, [float(x) for x in rng.integers(-3, 4, 5)]) for n, g in enumerate("pqpqpqprpp" * 2)]
    kind = "g string, {} int, e array<float>"
    df, asked = spark.createDataFrame([*v, ("p", 90, None), (None, 91, [1.0] * 5)], kind.format("doc")), spark.createDataFrame([*q, ("p", 70, None)], kind.format("query"))
    want = {}
    for g, i, e in q:
        score = {n: float(np.dot(e, x)) for h, n, x in v if h == g}
        want |= {(i, rank): (n, score[n]) for rank, n in enumerate(sorted(score, key=lambda n: (-score[n], n))[:6], 1)}
    for tile in ((4096, 512), (7, 3)):
        got = retrieve.dense_within(df, asked, "g", "doc", "query", "e", 6, tile)
        assert {(r.query_id, r["rank"]): (r.doc, r.score) for r in got.collect()} == want
