"""Command line: ``python -m threadloom.cli COMMAND --workspace FOLDER ...``, or ``list`` and ``run`` for the registered queries.

The commands are the stages of `pipeline.Workspace`. Those that ask a model take ``--completion module:function`` (a maker of a
completion; the built-in stub by default), those that fetch take ``--transport module:function``.
"""

from __future__ import annotations

import argparse
import importlib

from threadloom import pipeline
from threadloom.operators import backends, metadata_metrics
from threadloom.plans import registry
from threadloom.session import local_session

GROUPS = {
    "dataset": ("formatted_discussion", "file_references", "thread_posts", "timeline_events", "linked_pull_requests", "label_sets", "actor_typology", "dataset_summary", "state_distribution", "comment_count_filter"),
    "extraction": ("rule_artifacts", "rule_type_counts", "rule_tag_inference", "extraction_run_totals", "comment_jobs"),
    "retrieval": ("bm25_topk", "dense_topk", "hybrid_rrf", "context_budget", "sliding_chunks", "structural_chunks"),
    "metrics": ("type_overlap_per_issue", "type_macro", "type_vocab_overall", "type_per_type_confusion", "tag_pooled_grouping_sets", "tag_macro", "metadata_macro", "metadata_overall", "coverage_penalty", "summary_per_type", "summary_overall"),
    "comparison": ("comparison_per_issue", "comparison_macro", "comparison_per_type", "comparison_overall", "comparison_tag_frequency"),
    "leaderboard": ("leaderboard_components", "leaderboard_rrf", "leaderboard_combined", "leaderboard_with_metadata", "profile_points"),
    "reports": ("dataset_stats", "mean_f1_by_type", "top_types", "type_ring", "box_stats", "tag_shares", "viewer_rows"),
}

#: Command -> stages of other names that it stands for (a variant is a suffix of the command: without context, with examples, by rules).
SUFFIXES = {"": "context", "-no-context": "no-context", "-few-shot": "few-shot"}


def _load(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _parser() -> tuple[argparse.ArgumentParser, dict]:
    parser = argparse.ArgumentParser(prog="threadloom", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    actions: dict = {}

    def command(name: str, help_: str, run, *options: str) -> None:
        p = sub.add_parser(name, help=help_)
        p.add_argument("--workspace", required=True)
        p.add_argument("--cpus", type=int, default=8)
        for o in options:
            OPTIONS[o](p)
        actions[name] = run

    issues, models, prompts = ("issue", "limit"), ("completion", "model"), ("max_chars",)
    command("fetch-repo", "raw issues from the issue service", lambda w, a: w.fetch(_load(a.transport), a.repository, **_fetch(a)), "transport", "repositories", "comments")
    command("load-repo", "raw issues from JSON files", lambda w, a: w.load(a.source, a.repository), "source", "repository")
    command("curate-repo", "curated records", lambda w, a: w.curate(a.min_comments, a.max_comments), "comments")
    command("build-dataset", "fetch and curate", lambda w, a: w.build(_load(a.transport), a.repository, **_fetch(a)), "transport", "repositories", "comments")
    command("load-extraction", "extraction documents of one side", lambda w, a: w.load_extraction(a.source, a.repository, a.side, a.model), "source", "repository", "side", "model_or_none")
    for name in ("extract-discussion-artifacts", "extract-discussion-entities"):
        command(name, "artifacts of comments by a model", lambda w, a: w.extract_model(backends.runner(a.completion), a.model, a.issue, a.limit), *models, *issues)
    command("extract-discussion-artifacts-regex", "artifacts of comments by rules", lambda w, a: w.extract_rules(a.issue, a.limit), *issues)
    command("retrieve-code-chunks", "chunks and index of a source snapshot", lambda w, a: w.chunk(a.source, a.repository), "source", "repository")
    for suffix, variant in SUFFIXES.items():
        command("generate-issue-thoughts" + suffix, f"prompts ({variant}) and a model's answers", lambda w, a, v=variant: (w.prompts(v, a.issue, a.limit, a.max_chars), w.respond(backends.runner(a.completion), a.model)), *models, *issues, *prompts)
        command("extract-derived-artifacts" + suffix, "artifacts of the answers", lambda w, a: w.derive(backends.runner(a.completion)), "completion")
    for metric in pipeline.METRICS:
        command(f"compute-{metric}-metrics", f"{metric} agreement", lambda w, a, m=metric: _scored(w, a, (m,)), *SCORED)
    command("compute-all-metrics", "all four", lambda w, a: _scored(w, a, pipeline.METRICS), *SCORED)
    command("compute-extraction-comparison", "rules against the artifacts of a side", lambda w, a: w.compare(a.side, a.model), "side", "model_or_none")
    command("build-leaderboard", "boards", lambda w, a: w.leaderboard(a.reports, a.k, a.points_max, a.points_step), "reports", "board")
    for name in ("visualize-metrics", "visualize-extraction-comparison"):
        command(name, "data and page of each figure", lambda w, a: w.figures())
    command("view", "a page of the issues", lambda w, a: w.viewer())
    return parser, actions


SCORED = ("model_or_none", "repository_or_none", "issue", "matching")
OPTIONS = {
    "transport": lambda p: p.add_argument("--transport", required=True, help="module:function (query, variables) -> payload"),
    "completion": lambda p: p.add_argument("--completion", default="stub"),
    "model": lambda p: p.add_argument("--model", required=True),
    "model_or_none": lambda p: p.add_argument("--model"),
    "repositories": lambda p: p.add_argument("--repository", action="append", required=True),
    "repository": lambda p: p.add_argument("--repository", required=True),
    "repository_or_none": lambda p: p.add_argument("--repository"),
    "source": lambda p: p.add_argument("--source", required=True),
    "side": lambda p: p.add_argument("--side", choices=("human", "model"), default="human"),
    "issue": lambda p: p.add_argument("--issue", type=int),
    "limit": lambda p: p.add_argument("--limit", type=int),
    "max_chars": lambda p: p.add_argument("--max-chars", type=int, default=32_768),
    "comments": lambda p: (p.add_argument("--min-comments", type=int, default=0), p.add_argument("--max-comments", type=int)),
    "matching": lambda p: (p.add_argument("--threshold", type=float, default=0.82), p.add_argument("--similarity", choices=metadata_metrics.METHODS, default="max_all"), p.add_argument("--normalised", action="store_true")),
    "reports": lambda p: p.add_argument("--reports", help="folder of report files of earlier runs"),
    "board": lambda p: (p.add_argument("--k", type=int, default=60), p.add_argument("--points-max", type=int, default=100), p.add_argument("--points-step", type=int, default=1)),
}


def _fetch(a: argparse.Namespace) -> dict:
    return {"min_comments": a.min_comments, "max_comments": a.max_comments}


def _scored(w: pipeline.Workspace, a: argparse.Namespace, metrics: tuple[str, ...]) -> dict[str, str]:
    failed = w.score(metrics, a.model, a.repository, a.issue, a.threshold, a.similarity, a.normalised)
    for metric, why in failed.items():
        print(f"{metric} failed: {why}")
    return failed


def main(argv: list[str] | None = None) -> int:
    parser, actions = _parser()
    sub = next(x for x in parser._actions if isinstance(x, argparse._SubParsersAction))
    sub.add_parser("list", help="names of queries and groups")
    run = sub.add_parser("run", help="run queries or a group and write each result to its own folder")
    run.add_argument("names", nargs="+")
    run.add_argument("--data", required=True)
    run.add_argument("--out", required=True)
    run.add_argument("--format", choices=("parquet", "json"), default="parquet")
    run.add_argument("--cpus", type=int, default=8)
    args = parser.parse_args(argv)
    if args.command in actions:
        out = actions[args.command](pipeline.Workspace(local_session(args.cpus), args.workspace), args)
        return int(isinstance(out, dict) and bool(out))
    queries = registry.queries()
    if args.command == "list":
        for group, names in GROUPS.items():
            print(f"{group}: {', '.join(names)}")
        print("all:", ", ".join(sorted(queries)))
        return 0
    names = [q for n in args.names for q in GROUPS.get(n, (n,))]
    unknown = [n for n in names if n not in queries]
    if unknown:
        parser.error(f"unknown: {', '.join(unknown)}")
    spark = local_session(args.cpus)
    for n in names:
        queries[n](spark, args.data).write.mode("overwrite").format(args.format).save(f"{args.out}/{n}")
        print(f"{args.out}/{n}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
