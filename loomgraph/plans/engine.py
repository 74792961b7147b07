"""The tools of the service as methods that return DataFrames."""

from __future__ import annotations

import os
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.embedding import Embedder, hash_embedder
from loomgraph.operators import graph, skills, snapshots, usage
from loomgraph.operators.discovery import detect_frameworks
from loomgraph.operators.results import response, response_length
from loomgraph.plans import index as indexing
from loomgraph.plans import search
from loomgraph.plans.store import CodeStore
from loomgraph.schema import TOOL_CALLS, conform
from loomgraph.session import materialised
from loomgraph.settings import Settings
from loomgraph.sources.repo_changes import stream_changes
from loomgraph.sources.repo_files import list_trees, marker_listing, repo_id
from loomgraph.sources.skills import parse_skills, read_documents, valid_skills
from loomgraph.streaming.watch import Watchers


class Engine:
    """Search, graph, advice and usage over the repositories indexed in one store.

    The repositories indexed last are the active ones and scope searches; with
    none, all repositories are searched.
    """

    def __init__(
        self, spark: SparkSession, settings: Settings | None = None, embed: Embedder | None = None
    ):
        self.spark = spark
        self.settings = settings or Settings.from_env()
        self.embed = embed or hash_embedder(self.settings.embedding_dim)
        self.store = CodeStore(spark, self.settings.data_dir, self.settings.store_buckets)
        self.watchers = Watchers()
        self.active_paths: list[str] = []
        self.response: DataFrame | None = None  # of the last call, as one row
        self.problems: DataFrame | None = None  # skipped entries of the last run

    @property
    def active(self) -> str | None:
        """The repository indexed last; searches cover all of the call that indexed it."""
        return self.active_paths[-1] if self.active_paths else None

    @active.setter
    def active(self, path: str | None) -> None:
        self.active_paths = [] if path is None else [path]

    # --- indexing ---------------------------------------------------------------

    def _entries(self, paths: list[str]) -> DataFrame:
        return list_trees(self.spark, paths)

    def index_repository(
        self, path: str | list[str], incremental: bool = True, languages: list[str] | None = None
    ) -> DataFrame:
        """Index one or several repositories; one report row per repository."""
        paths = [path] if isinstance(path, str) else list(path)
        roots = {repo_id(p): os.path.realpath(p) for p in paths}
        run = indexing.index(
            self.store, self._entries(paths), roots, incremental, languages, self.settings, self.embed
        )
        self.active_paths = paths
        self.problems = run.problems
        if self.settings.auto_watch:
            for one in paths:
                self.watch(one)
        return run.report.withColumn("duration_seconds", F.round(F.lit(run.seconds), 2))

    def refresh_index(self, path: str | list[str] | None = None) -> DataFrame:
        return self.index_repository(path or (self._require_active() and self.active_paths), incremental=True)

    def watch(self, path: str, **trigger):
        """Refresh ``path`` after each burst of changes; a second call returns the running query."""
        changes = stream_changes(self.spark, [path])
        folder = f"{self.store.root}/watch/{repo_id(path)}-{uuid.uuid4().hex}"
        refresh = lambda repos: self.refresh_index(path)
        return self.watchers.start(
            repo_id(path), changes, refresh, folder, self.settings.debounce_seconds, **trigger
        )

    def unwatch(self, path: str | None = None) -> int:
        """Stop watching one repository or all; returns how many were stopped."""
        return self.watchers.stop_all() if path is None else int(self.watchers.stop(repo_id(path)))

    def cancel_indexing(self) -> dict:
        stopped = indexing.cancel_indexing(self.spark)
        return {"status": "cancelling" if stopped else "idle"}

    def index_status(self, path: str | None = None) -> DataFrame:
        """Totals and languages of one repository, or totals of all."""
        state = self.store.repo_state().drop("snapshot")
        if path is None:
            return state
        wanted = repo_id(path)
        languages = snapshots.language_counts(self.store.current("file_state", [wanted]))
        listed = languages.groupBy("repo_id").agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "files")))).alias("languages")
        )
        row = self.spark.createDataFrame([(wanted,)], "repo_id string")
        return (
            row.join(state, "repo_id", "left")
            .join(listed, "repo_id", "left")
            .withColumn("indexed", F.col("indexed_at").isNotNull())
        )

    def stale_report(self, path: str | None = None) -> DataFrame:
        target = path or self._require_active()
        found = indexing.staleness(self.store, self._entries([target]), [repo_id(target)], self.settings)
        row = self.spark.createDataFrame([(repo_id(target),)], "repo_id string")
        return row.join(found, "repo_id", "left").withColumn(
            "is_stale", F.coalesce("is_stale", F.lit(True))
        )

    def stale_warning(self) -> dict | None:
        """What to warn of: files of the active repositories that changed since they were indexed.

        Equal tree digests settle it; only otherwise are the files' states compared.
        """
        total, preview = 0, []
        for path in self.active_paths if self.settings.stale_check else []:
            entries = self._entries([path])
            if indexing.is_settled(self.store, entries, repo_id(path)):
                continue
            row = indexing.staleness(self.store, entries, [repo_id(path)], self.settings).first()
            if row is not None and row.is_stale:
                total += row.stale_count
                preview += row.preview
        if not total:
            return None
        message = f"{total} file(s) changed since last index. Call refresh_index to update the knowledge base."
        return {"stale_warning": message, "changed_files": preview[: snapshots.PREVIEW]}

    def _require_active(self) -> str:
        if self.active is None:
            raise ValueError("no active repository: pass a path or index one first")
        return self.active

    # --- search -----------------------------------------------------------------

    def _scope(self) -> tuple[DataFrame, DataFrame, str | None]:
        ids = sorted({repo_id(p) for p in self.active_paths}) or None
        only = ids[0] if ids and len(ids) == 1 else None
        return self.store.current("nodes", ids), self.store.current("vectors", ids), only

    def _edges(self) -> DataFrame:
        return self.store.current("edges", sorted({repo_id(p) for p in self.active_paths}) or None)

    def _question(self, text: str, column: str = "query_text") -> DataFrame:
        return self.spark.createDataFrame([(0, text)], f"query_id int, {column} string")

    def _recorded(self, tool: str, results: DataFrame, text: str) -> DataFrame:
        """The rows of a call, evaluated once. Its response goes to ``self.response`` and is
        what the usage log counts."""
        kept = materialised(results)
        self.response = response(kept, text, self.stale_warning())
        call = self.response.select(
            F.lit(tool).alias("tool"),
            F.current_timestamp().alias("ts"),
            response_length().alias("response_len"),
            F.col("total").alias("result_count"),
            F.lit(text).alias("query"),
        )
        self.store.append("tool_calls", conform(call, TOOL_CALLS))
        return kept

    def respond(self, tool: str, *args, **named) -> DataFrame:
        """A tool's response: one row of results in sparse JSON, total, query and stale warning."""
        getattr(self, tool)(*args, **named)
        return self.response

    def search_code(
        self, query: str, top_k: int = 10, language: str | None = None, file_pattern: str | None = None
    ) -> DataFrame:
        nodes, vectors, repo = self._scope()
        found = search.search_code(
            nodes, vectors, self._question(query), top_k, language, file_pattern, repo, self.embed
        )
        return self._recorded("search_code", found, query)

    def find_symbol(
        self, name: str, kind: str | None = None, include_relationships: bool = True
    ) -> DataFrame:
        nodes, vectors, repo = self._scope()
        asked = self._question(name, "name").withColumn("kind", F.lit(kind).cast("string"))
        edges = self._edges()
        found = search.find_symbol(
            nodes, vectors, edges, asked, include_relationships, repo, self.embed
        )
        return self._recorded("find_symbol", found, name)

    def _related(self, tool: str, plan, target: str, depth: int, mode: str, reverse: bool) -> DataFrame:
        nodes, vectors, repo = self._scope()
        if mode == "graph":
            edges = self._edges().filter(
                F.col("relationship_name").isin(
                    "calls", "imports", "inherits_from", "exports_symbol", "contains_symbols", "methods"
                )
            )
            named = nodes.filter(
                (F.col("qualified_name") == target) | (F.col("name") == target) | (F.col("file_path") == target)
            )
            starts = named.select(F.col("id").alias("node_id"))
            found = (
                graph.reachable(edges, starts, depth, reverse)
                .filter("depth > 0")
                .groupBy("node").agg(F.min("depth").alias("depth"))
                .join(nodes, F.col("node") == F.col("id"))
                .select("id", "type", "name", "kind", "file_path", "start_line", "end_line", "source_module", "depth")
            )
        else:
            found = plan(nodes, vectors, self._question(target), repo, self.embed)
        return self._recorded(tool, found, target)

    def get_dependencies(self, target: str, depth: int = 1, mode: str = "meaning") -> DataFrame:
        """What ``target`` depends on, by meaning or, with ``mode="graph"``, by edges."""
        return self._related("get_dependencies", search.get_dependencies, target, depth, mode, False)

    def get_dependents(self, target: str, depth: int = 1, mode: str = "meaning") -> DataFrame:
        return self._related("get_dependents", search.get_dependents, target, depth, mode, True)

    def get_file_summary(self, path: str) -> DataFrame:
        nodes, _, repo = self._scope()
        return self._recorded("get_file_summary", search.file_summary(nodes, path, repo), path)

    # --- usage ------------------------------------------------------------------

    def usage_stats(self, days: int = 7) -> DataFrame:
        return usage.summary(self.store._read("tool_calls"), days)

    def usage_daily(self, days: int = 7) -> DataFrame:
        return usage.last_days(self.store._read("tool_calls"), days)

    def usage_reset(self) -> None:
        self.store.clear("tool_calls")

    # --- advice -----------------------------------------------------------------

    def _skills(self) -> DataFrame:
        if not self.settings.advisor_enabled:
            raise RuntimeError("the advisor is disabled")
        roots = {"builtin": self.settings.builtin_skills_dir, "user": self.settings.user_skills_dir}
        if self.active:
            roots["project"] = os.path.join(self.active, ".loomgraph", "skills")
        documents = read_documents(self.spark, {k: v for k, v in roots.items() if v})
        return skills.register(valid_skills(parse_skills(documents)))

    def advise(self, query: str, top_k: int = 3) -> DataFrame:
        registered = skills.embedded(self._skills(), self.embed)
        frameworks: list[str] = []
        if self.active:
            row = detect_frameworks(marker_listing(self._entries([self.active]))).first()  # one row per repository
            frameworks = list(row.frameworks) if row else []
        matches = skills.match(registered, self._question(query), top_k, frameworks, self.embed)
        expanded = skills.expand_dependencies(matches, registered)
        found = skills.advice(expanded, registered, self.settings.advisor_min_similarity)
        return self._recorded("advise", found, query)

    def list_skills(self) -> DataFrame:
        return skills.skill_list(self._skills())

    def with_settings(self, **changes) -> "Engine":
        return Engine(self.spark, replace(self.settings, **changes), self.embed)
