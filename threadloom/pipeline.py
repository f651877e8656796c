"""Whole runs over a folder: fetch, curate, extract, retrieve, ask, derive, score, compare, rank, draw.

A workspace is a folder of stage tables (parquet), each with a manifest of its rows and settings beside it. Every stage reads the tables
of earlier ones and replaces its own as a whole, so a run can be taken up at any stage.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import align, backends, code_chunks, compare, curate, extract, leaderboard, metadata_metrics, prompting, reports, retrieve, summary_metrics, tag_metrics, type_metrics
from threadloom.sources import files, forge

METRICS = ("type", "tag", "metadata", "summary")
#: How prompts are put together: with retrieved code, without, or with worked examples.
VARIANTS = ("context", "no-context", "few-shot")


class Workspace:
    """Stage tables below a folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def has(self, name: str) -> bool:
        try:
            self.spark.read.parquet(f"{self.root}/{name}").schema  # noqa: B018 - asks whether it is there
        except AnalysisException:
            return False
        return True

    def read(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"stage {name} isn't in {self.root}: run the command that makes it first")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def write(self, name: str, df: DataFrame, **settings: object) -> DataFrame:
        files.write_stage(df, self.root, name)
        out = self.read(name)
        files.write_json(files.manifest(out, **{k: str(v) for k, v in settings.items() if v is not None}).coalesce(1), f"{self.root}/_manifests/{name}")
        return out

    # ------------------------------------------------------------ dataset

    def fetch(self, transport: forge.Transport, repositories: Iterable[str], **options: object) -> DataFrame:
        """Raw issues of repositories from the issue service that the transport reaches; options as `forge` names them."""
        forge.register(self.spark, transport)
        reader = self.spark.read.format("issue_forge").option("repositories", ",".join(repositories))
        for k, v in options.items():
            if v is not None:
                reader = reader.option(k, str(v))
        raw = reader.load().select("repository", F.from_json("payload", files.RAW_ISSUE).alias("r")).select("repository", "r.*")
        return self.write("raw_issue", self._snapshots(raw), source="service", **options)

    def load(self, folder: str, repository: str) -> DataFrame:
        """Raw issues of one repository from JSON files ``issue_*.json``; other repositories of the stage stay."""
        new = self._snapshots(files.read_documents(self.spark, folder, files.RAW_ISSUE).drop("file").withColumn("repository", F.lit(repository)))
        if self.has("raw_issue"):
            old = files.write_stage(self.read("raw_issue").where(F.col("repository") != repository), self.root, "_raw_issue_before")
            new = new.unionByName(self.spark.read.parquet(old), allowMissingColumns=True)
        return self.write("raw_issue", new, source=folder)

    def _snapshots(self, raw: DataFrame) -> DataFrame:
        now = datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        return raw.where("number is not null").withColumns({"snapshot_id": F.xxhash64("repository", "number"), "fetched_at": F.lit(now)})

    def curate(self, least: int = 0, most: int | None = None) -> DataFrame:
        """Curated records of issues with least to most comments."""
        raw = curate.with_comment_count(self.read("raw_issue"), least, most)
        c = curate.curate(raw, distinct=True).withColumns({"record_id": F.col("snapshot_id"), "ingested_at": F.current_timestamp()})
        return self.write("curated", c, min_comments=least, max_comments=most)

    def build(self, transport: forge.Transport, repositories: Iterable[str], **options: object) -> DataFrame:
        self.fetch(transport, repositories, **options)
        return self.curate()

    # ------------------------------------------------------------ artifacts

    def _threads(self, number: int | None, limit: int | None) -> DataFrame:
        return prompting.limited(self.read("curated"), ["issue_number", "record_id"], number, limit)

    def extract_rules(self, number: int | None = None, limit: int | None = None) -> DataFrame:
        return self.write("rule_artifact", extract.extract(self._threads(number, limit), issue_body=True), issue=number, limit=limit)

    def extract_model(self, make: Callable, model_id: str, number: int | None = None, limit: int | None = None) -> DataFrame:
        """Comments through a model, as artifacts of the model's side."""
        done = backends.model_artifacts(extract.comments(self._threads(number, limit)), make).withColumn("model_id", F.lit(model_id))
        return self._add_artifacts(self.write("model_extraction", done, model=model_id, issue=number, limit=limit), "model", model_id)

    def _add_artifacts(self, rows: DataFrame, side: str, model_id: str | None) -> DataFrame:
        have = rows.where("artifact_idx is not null").select("repository", F.lit(model_id).cast("string").alias("model_id"), "issue_number", "comment_idx", "artifact_idx", "type", "summary", "tags", "metadata")
        asked = rows.select("repository", F.lit(model_id).cast("string").alias("model_id"), "issue_number").distinct()
        none = asked.join(have.select("repository", "issue_number").distinct(), ["repository", "issue_number"], "left_anti")
        new = files.artifact_rows(have.unionByName(none, allowMissingColumns=True).select(have.columns), side)
        if self.has("artifact"):
            same = (F.col("side") == side) & F.col("model_id").eqNullSafe(F.lit(model_id))
            old = files.write_stage(self.read("artifact").where(~same), self.root, "_artifact_before")
            new = new.unionByName(self.spark.read.parquet(old))
        return self.write("artifact", new)

    def load_extraction(self, folder: str, repository: str, side: str, model_id: str | None = None) -> DataFrame:
        """Extraction documents ``issue_*.json`` of one side of one repository, beside those that are there."""
        d = files.read_documents(self.spark, folder, files.EXTRACTION).withColumns({"repository": F.lit(repository), "model_id": F.lit(model_id).cast("string")})
        new = files.artifact_rows(files.extraction_artifacts(d), side)
        if self.has("artifact"):
            same = (F.col("side") == side) & F.col("model_id").eqNullSafe(F.lit(model_id)) & (F.col("repository") == repository)
            old = files.write_stage(self.read("artifact").where(~same), self.root, "_artifact_before")
            new = new.unionByName(self.spark.read.parquet(old))
        return self.write("artifact", new, side=side, source=folder)

    # ------------------------------------------------------------ retrieval and answers

    def chunk(self, folder: str, repository: str, extensions: Iterable[str] = tuple(code_chunks.SYMBOLS) + ("py", "md")) -> DataFrame:
        """Chunks of the source files of a repository's snapshot, with an index that later runs reuse."""
        found = code_chunks.chunk_files(files.snapshot_files(self.spark, folder, tuple(extensions)).withColumn("repository", F.lit(repository)))
        chunks = found.withColumn("chunk_no", F.xxhash64("repository", "chunk_id"))
        if self.has("chunk"):
            old = files.write_stage(self.read("chunk").where(F.col("repository") != repository), self.root, "_chunk_before")
            chunks = chunks.unionByName(self.spark.read.parquet(old))
        out = self.write("chunk", chunks, source=folder)
        retrieve.save_index(out, f"{self.root}/chunk_index", "chunk_no", "text")
        return out

    def prompts(self, variant: str = "context", number: int | None = None, limit: int | None = None, max_chars: int = 32_768) -> DataFrame:
        """The prompt of each issue: repository, issue_number, prompt (null if it can't be made short enough), context_chunks."""
        if variant not in VARIANTS:
            raise ValueError(f"unknown variant {variant!r}")
        key = ["repository", "issue_number"]
        issues = prompting.limited(prompting.issue_text(self.read("raw_issue"), self.read("curated")), ["issue_number"], number, limit)
        if variant == "context":
            chunks = self.read("chunk")
            index = retrieve.ensure_index(chunks, f"{self.root}/chunk_index", "chunk_no", "text")
            vectors = index["vectors"].join(chunks.select("chunk_no", "repository"), "chunk_no")
            asked = retrieve.hashed_vectors(issues.select(F.struct(*key).alias("q"), F.concat_ws("\n\n", "title", "body").alias("text")), "q", "text").select("q.*", "embedding")
            near = retrieve.for_issues(issues, chunks, (vectors, asked)).join(chunks.drop("repository"), "chunk_no")
            out = prompting.prompts_within(issues, near.select(*key, "rank", "chunk_id", "file_path", "symbol_name", "start_line", "end_line", "text"), key, max_chars, 10, "rank")
        else:
            examples = None
            if variant == "few-shot":
                human = align.latest_artifacts(self.read("artifact")).where("side = 'human'")
                said = prompting.example_responses(human, key, list(align.ORDER), 5).join(issues, key)
                examples = retrieve.exclude_self(said.select(*key, "title", F.substring("body", 1, 900).alias("body"), "response"), issues, ["issue_number"], ["issue_number"], 3)
                one = F.struct("example_no", F.col("example_issue_number").alias("issue_number"))
                shown = examples.select(*key, one.alias("e"))
                text = said.select("repository", F.col("issue_number").alias("x"), "title", F.substring("body", 1, 900).alias("body"), "response")
                joined = shown.join(text, (shown.repository == text.repository) & (F.col("e.issue_number") == F.col("x"))).select(shown.repository, "issue_number", F.struct("e.example_no", F.col("x").alias("issue_number"), "title", "body", "response").alias("e"))
                issues = issues.join(joined.groupBy(*key).agg(F.array_sort(F.collect_list("e")).alias("examples")), key, "left")
                examples = F.col("examples")
            full = prompting.prompt(F.col("number"), F.col("title"), F.col("body"), None, examples)
            out = issues.select(*key, F.when(F.char_length(full) <= max_chars, full).alias("prompt"), F.lit(0).alias("context_chunks"))
        return self.write("prompt", out.withColumn("variant", F.lit(variant)), variant=variant, issue=number, limit=limit, max_chars=max_chars)

    def respond(self, make: Callable, model_id: str) -> DataFrame:
        """The model's answer to each prompt of the stage."""
        return self.write("response", backends.answers(self.read("prompt"), make, model_id), model=model_id)

    def derive(self, make: Callable) -> DataFrame:
        """Artifacts of the answers, as artifacts of the side of the model that answered."""
        responses = self.read("response")
        rows = self.write("derived", backends.derived_artifacts(responses, make))
        for r in responses.select("model_id").distinct().collect():  # the models of one run
            self._add_artifacts(rows.where(F.col("model_id") == r.model_id).drop("model_id"), "model", r.model_id)
        return rows

    # ------------------------------------------------------------ scores

    def score(self, metrics: Iterable[str] = METRICS, model_id: str | None = None, repository: str | None = None, number: int | None = None, threshold: float = 0.82, method: str = "max_all", normal: bool = False) -> dict[str, str]:
        """Tables ``type_*``, ``tag_*``, ``metadata_*``, ``summary_*`` over all targets at once; what failed and why."""
        a = self.read("artifact")
        for column, value in (("model_id", model_id), ("repository", repository), ("issue_number", number)):
            if value is not None:
                a = a.where((F.col(column) == value) | (F.lit(column == "model_id") & (F.col("side") == "human")))
        names = ("token_f1", "trigram", "logistic")

        def types() -> dict[str, DataFrame]:
            flags = type_metrics.type_flags(align.type_sets(a, normal))
            issues = type_metrics.per_issue(flags)
            return {"type_issue": issues, "type_macro": type_metrics.macro(issues), "type_overall": type_metrics.vocabulary(flags), "type_by_type": type_metrics.per_type(flags)}

        def tags() -> dict[str, DataFrame]:
            counts = tag_metrics.tag_counts(align.tag_sets(a, normal))
            pooled = tag_metrics.pooled(counts)
            return {"tag_issue": pooled.where("level = 'issue'").drop("type"), "tag_overall": pooled.where("level = 'overall'").drop("type", "issue_number"), "tag_macro": tag_metrics.macro(counts), "tag_by_type": reports.tag_f1_by_type(counts), "tag_frequency": tag_metrics.frequency(align.aligned(a, normal))}

        def metadata() -> dict[str, DataFrame]:
            both = align.aligned(a, normal)
            issues = metadata_metrics.per_issue(both, threshold, method)
            return {"metadata_issue": issues, "metadata_macro": metadata_metrics.macro(issues), "metadata_overall": metadata_metrics.overall(both, threshold, method), "metadata_by_type": metadata_metrics.per_issue_type(both, threshold, method)}

        def summaries() -> dict[str, DataFrame]:
            both = align.aligned(a, normal)
            issues, by_type = summary_metrics.per_issue(both), summary_metrics.per_type(both)
            vector = summary_metrics.per_issue(both, summary_metrics.vectors, ("precision", "recall", "f1", "cosine"))
            return {"summary_issue": issues, "summary_by_type": by_type, **{f"summary_overall_{n}": summary_metrics.overall(issues, by_type, n) for n in names}, "summary_vectors": vector}

        failed: dict[str, str] = {}
        for metric, tables in (("type", types), ("tag", tags), ("metadata", metadata), ("summary", summaries)):
            if metric not in metrics:
                continue
            try:
                for name, df in tables().items():
                    self.write(f"metrics/{name}", df, threshold=threshold, similarity=method, normalised=normal)
            except Exception as e:  # noqa: BLE001 - the other metrics still count
                failed[metric] = str(e)[:500]
        return failed

    def components(self) -> DataFrame:
        """The components that the stage's metric tables have."""
        wanted = (("type_f1", "type_macro", "f1"), ("metadata_f1", "metadata_macro", "f1"), ("metadata_soft_f1", "metadata_macro", "soft_f1"), ("tag_f1", "tag_overall", "f1"))
        found = [(c, self.read(f"metrics/{t}"), v) for c, t, v in wanted if self.has(f"metrics/{t}")]
        if self.has("metrics/summary_vectors"):
            mean = self.read("metrics/summary_vectors").groupBy("model_id", "repository").agg(F.avg("penalised_cosine").alias("cosine"), F.avg("penalised_f1").alias("f1"))
            found += [("summary_vector_cosine", mean, "cosine"), ("summary_vector_f1", mean, "f1")]
        if not found:
            raise FileNotFoundError("no metric tables: run the scores first")
        return leaderboard.unpivot(found)

    def leaderboard(self, report_folder: str | None = None, k: int = 60, points_max: int = 100, points_step: int = 1) -> DataFrame:
        """Boards from the metric tables, or from report files of earlier runs."""
        c = files.report_components(self.spark, report_folder) if report_folder else self.components()
        c = self.write("metrics/components", c)
        self.write("leaderboard_by_repository", leaderboard.per_repository(c, k, points_max, points_step))
        return self.write("leaderboard", leaderboard.combined(c, k, points_max, points_step), k=k, points_max=points_max, points_step=points_step)

    def compare(self, side: str = "human", model_id: str | None = None) -> None:
        """Rules against the artifacts of people or of a model."""
        candidate = align.latest_artifacts(self.read("artifact")).where(F.col("side") == side)
        if model_id:
            candidate = candidate.where(F.col("model_id") == model_id)
        both = compare.side_by_side(self.read("rule_artifact"), candidate, model_id or side)
        issues = self.write("comparison/issue", compare.per_issue(both))
        self.write("comparison/macro", compare.macro(issues))
        self.write("comparison/by_type", compare.per_type(both))
        self.write("comparison/tag_frequency", compare.tag_frequency(both))

    # ------------------------------------------------------------ figures

    def figures(self) -> list[str]:
        """The data of each figure as a table below ``figures``, a page of each, and their names."""
        out: dict[str, DataFrame] = {}
        if self.has("metrics/components"):
            c = self.read("metrics/components")
            names = tuple(r.component for r in c.select("component").distinct().orderBy("component").collect())  # at most seven
            out |= {"component_heatmap": leaderboard.component_means(c), "model_profile": leaderboard.profile_points(c, names), "leaderboard": self.read("leaderboard").orderBy(F.desc("points"), "model_id") if self.has("leaderboard") else leaderboard.combined(c)}
        if self.has("metrics/type_issue"):
            issues, tags = self.read("metrics/type_issue"), self.read("metrics/tag_issue") if self.has("metrics/tag_issue") else None
            by_type = reports.mean_by_type(self.read("metrics/type_by_type"), "f1")
            out |= {"type_box": reports.box_stats(issues, "f1"), "type_values": reports.issue_series(issues, "f1"), "type_bars": by_type, "type_ring": reports.spread(by_type, "f1")}
            if tags is not None:
                out |= {"tag_box": reports.box_stats(tags, "f1"), "type_tag_scatter": reports.scatter(reports.issue_series(issues, "f1"), reports.issue_series(tags, "f1")), "tag_bars": self.read("metrics/tag_by_type"), "tag_frequency": self.read("metrics/tag_frequency")}
        if self.has("comparison/issue"):
            means = ("type_f1", "tag_f1", "metadata_f1", "summary_f1")
            out |= {"comparison_overall": reports.across_repositories(self.read("comparison/issue"), means), "comparison_heatmap": self.read("comparison/macro").select("repository", *means), "comparison_by_type": self.read("comparison/by_type")}
        for name, df in out.items():
            files.save_page(self.spark, reports.page(self.write(f"figures/{name}", df), name), f"{self.root}/figures/{name}.html")
        return sorted(out)

    def viewer(self) -> str:
        """One page of the issues with their artifacts; its path."""
        rows = reports.viewer_rows(self.read("raw_issue"), align.latest_artifacts(self.read("artifact"))).orderBy("repository", "issue_number")
        files.save_page(self.spark, reports.page(rows, "issues"), f"{self.root}/viewer.html")
        return f"{self.root}/viewer.html"
