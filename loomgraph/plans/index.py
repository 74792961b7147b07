"""Indexing: list, compare with the stored state, read once, parse, build, write what changed.

The tree is listed once. Files whose size and time of change equal the stored state's are
taken as unchanged; the others are read, once, into a table that hashes, the minified test
and the parser all use, so a run sees one moment of every file.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.embedding import Embedder
from loomgraph.operators import code_graph, snapshots
from loomgraph.operators.digests import file_digest
from loomgraph.operators.discovery import is_minified, named_sources, repo_rules
from loomgraph.operators.results import index_report
from loomgraph.operators.source_text import FILE_KEY, decoded
from loomgraph.plans.search import index_vectors
from loomgraph.plans.store import CodeStore, REPO_STATE, new_snapshot
from loomgraph.schema import FILE_STATE, conform
from loomgraph.session import cut_lineage, materialised
from loomgraph.settings import Settings
from loomgraph.sources.repo_files import marker_listing, with_contents


class IndexBusyError(RuntimeError):
    """Another run is indexing the same repository."""


_guard = threading.Lock()
_running: dict[str, str] = {}  # repo_id -> job tag


def is_indexing() -> bool:
    with _guard:
        return bool(_running)


def cancel_indexing(spark) -> int:
    """Stop the jobs of all running index runs; their snapshots never become visible."""
    with _guard:
        tags = set(_running.values())
    for tag in tags:
        spark.sparkContext.cancelJobsWithTag(tag)
    return len(tags)


@dataclass
class IndexRun:
    snapshot: str
    report: DataFrame
    seconds: float
    problems: DataFrame  # repo_id, file_path, reason of every entry that was skipped


#: A file changed this shortly before it was last indexed may have changed again unseen.
RACY_MICROS = 2_000_000


def _scope(state: DataFrame, languages: list[str] | None) -> DataFrame:
    """Stored files the run may judge: a language filter must not delete other languages."""
    if not languages:
        return state
    wanted = set(languages) | ({"tsx"} if "typescript" in languages else set())
    return state.filter(F.col("language").isin(*wanted))


@dataclass
class Comparison:
    """A listed tree against the stored state."""

    differences: DataFrame  # repo_id, file_path, status, language, new_hash, old_hash, size, modified
    read: DataFrame  # repo_id, file_path, language, content: the files that were read
    problems: DataFrame  # repo_id, file_path, reason
    trees: DataFrame  # repo_id, tree_files, tree_digest, tree_newest


def listed_sources(entries: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """The files that names and rules let through; only marker files are read."""
    found = named_sources(entries.filter("kind = 'file'"), repo_rules(marker_listing(entries)), languages)
    return found.withColumnRenamed("relative_path", "file_path")


def tree_digests(sources: DataFrame) -> DataFrame:
    """One row per repository that tells a tree from another by its files' names, sizes and times."""
    digest = file_digest(F.col("file_path"), F.col("size"), F.col("modified"), F.col("reason"))
    return sources.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("tree_files"), F.bit_xor(digest).alias("tree_digest"), F.max("modified").alias("tree_newest")
    )


def compare(
    entries: DataFrame,
    stored: DataFrame,
    settings: Settings,
    languages: list[str] | None = None,
    trust_times: bool = True,
) -> Comparison:
    """Status of every file: new, changed, deleted, unchanged or skipped.

    Skipped are files that exist, or may, but can't be judged: unreadable ones, those below
    an unreadable directory, and those above the size limit. They keep what is stored of
    them. Only files whose size or time differs from the stored state's are read, all of
    them without ``trust_times``.
    """
    most = settings.max_file_size_kb * 1024
    sources = listed_sources(entries, languages)
    sources = sources.select(
        *FILE_KEY, "path", "language", "size", "modified", F.col("reason").alias("_reason"),
        F.when(F.col("size") > most, F.concat(F.lit("larger than "), F.lit(settings.max_file_size_kb), F.lit(" KB"))).otherwise(F.col("reason")).alias("reason"),
    )
    old = _scope(stored, languages).select(
        *FILE_KEY, F.col("content_hash").alias("old_hash"), F.col("size").alias("_size"), F.col("modified").alias("_modified"),
        F.unix_micros("last_indexed_at").alias("_at"),
    )
    same = F.col("_size").eqNullSafe(F.col("size")) & F.col("_modified").eqNullSafe(F.col("modified"))
    known = same & (F.col("modified") < F.col("_at") - RACY_MICROS) if trust_times else F.lit(False)
    listed = materialised(sources.join(old, FILE_KEY, "left").withColumn("known", F.coalesce(known, F.lit(False))))
    read = materialised(with_contents(listed.filter("not known and reason is null").repartition(*FILE_KEY)))

    judged = read.select(
        *FILE_KEY, "language", "size", "modified", "old_hash", "reason",
        F.sha2("content", 256).alias("new_hash"), F.coalesce(is_minified(F.col("file_path"), F.col("content")), F.lit(False)).alias("minified"),
    ).filter("not minified")
    trusted = listed.filter("known or reason is not null").withColumn("new_hash", F.when(F.col("reason").isNull(), F.col("old_hash")))
    columns = [*FILE_KEY, "language", "size", "modified", "old_hash", "new_hash", "reason"]
    now = judged.select(*columns).unionByName(trusted.select(*columns))
    status = (
        F.when(F.col("reason").isNotNull(), "skipped")
        .when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash") != F.col("old_hash"), "changed")
        .otherwise("unchanged")
    )
    now = now.withColumn("status", status)

    # A stored file that is not listed is gone, unless a directory above it could not be read.
    blind = entries.filter("kind = 'directory' and reason is not null").select("repo_id", F.col("relative_path").alias("above"))
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    missing = old.select(*FILE_KEY, "old_hash").join(now.select(*FILE_KEY), FILE_KEY, "left_anti")
    unseen = missing.select(*FILE_KEY, F.explode(above).alias("above")).join(blind, ["repo_id", "above"], "left_semi").select(*FILE_KEY).distinct()
    gone = missing.join(unseen.withColumn("_unseen", F.lit(True)), FILE_KEY, "left").withColumn("status", F.when(F.col("_unseen"), "skipped").otherwise("deleted"))

    differences = materialised(
        now.drop("reason").unionByName(gone.drop("_unseen"), allowMissingColumns=True)
        .select(*FILE_KEY, "status", "language", "new_hash", "old_hash", "size", "modified")
    )
    problems = now.filter("reason is not null").select(*FILE_KEY, "reason").unionByName(
        entries.filter("kind = 'directory' and reason is not null").select("repo_id", F.col("relative_path").alias("file_path"), "reason")
    )
    trees = tree_digests(listed.drop("reason").withColumnRenamed("_reason", "reason"))
    if languages:  # a part of the tree
        trees = trees.filter("false")
    return Comparison(differences, read.filter("reason is null").select(*FILE_KEY, "language", "content"), problems, trees)


def staleness(store: CodeStore, entries: DataFrame, repo_ids: list[str], settings: Settings) -> DataFrame:
    """Stale report per repository; files are read only where size or time of change differ."""
    found = compare(entries, store.current("file_state", repo_ids), settings)
    return snapshots.staleness(found.differences)


def is_settled(store: CodeStore, entries: DataFrame, repo: str) -> bool:
    """Whether a repository's tree has the digest of its last full index run.

    Then no file's size or time has changed, and no state of single files is looked at.
    """
    columns = ["tree_files", "tree_digest", "tree_newest"]
    stored = store.repo_state().filter(F.col("repo_id") == repo).select(*columns, F.unix_micros("indexed_at").alias("at")).first()
    if stored is None or stored.tree_digest is None or stored.tree_newest >= stored.at - RACY_MICROS:
        return False
    now = tree_digests(listed_sources(entries)).select(*columns).first()
    blind = not entries.filter("reason is not null").isEmpty()
    return not blind and now is not None and tuple(now) == tuple(stored)[:3]


def index(
    store: CodeStore,
    entries: DataFrame,
    roots: dict[str, str],
    incremental: bool = True,
    languages: list[str] | None = None,
    settings: Settings | None = None,
    embed: Embedder | None = None,
) -> IndexRun:
    """Index the repositories of ``entries`` (``roots``: repo_id -> path) in one run."""
    settings = settings or Settings.from_env()
    spark, tag = store.spark, f"index-{uuid.uuid4().hex}"
    with _guard:
        busy = sorted(set(roots) & set(_running))
        if busy:
            raise IndexBusyError(f"already indexing: {', '.join(busy)}")
        _running.update(dict.fromkeys(roots, tag))
    spark.sparkContext.addJobTag(tag)
    begin = time.time()
    try:
        snapshot, report, problems = _run(store, entries, roots, incremental, languages, settings, embed)
        return IndexRun(snapshot, report, time.time() - begin, problems)
    finally:
        spark.sparkContext.removeJobTag(tag)
        with _guard:
            for repo in roots:
                _running.pop(repo, None)


def _run(store, entries, roots, incremental, languages, settings, embed):
    spark = store.spark
    snapshot, repo_ids = new_snapshot(), sorted(roots)
    now = F.current_timestamp()
    found = compare(entries, store.current("file_state", repo_ids), settings, languages, trust_times=incremental)
    differences = found.differences
    if not incremental:
        # A full run makes every file anew, and still removes those that are gone.
        anew = F.when(F.col("status").isin("changed", "unchanged"), "new").otherwise(F.col("status"))
        differences = differences.withColumn("status", anew)
    touched = differences.filter("status in ('new', 'changed')")
    files = found.read.join(touched.select(*FILE_KEY), FILE_KEY, "left_semi").select(
        *FILE_KEY, "language", decoded(F.col("content")).alias("text")
    )
    entities = cut_lineage(code_graph.parse_files(files))

    rewritten = touched.filter("old_hash is not null").select(*FILE_KEY)
    buckets = [r[0] for r in rewritten.select(store.bucket()).distinct().collect()]

    def stamped(table: str, fresh: DataFrame, id_columns: list[str]) -> DataFrame:
        """Fresh rows; those of a file made anew keep the creation time of their id."""
        before = store.current(table, repo_ids, buckets).join(rewritten, FILE_KEY, "left_semi")
        born = before.groupBy(*id_columns).agg(F.min("created_at").alias("_born"))
        return (
            fresh.join(born, id_columns, "left")
            .withColumn("created_at", F.coalesce("_born", now))
            .withColumn("updated_at", now)
            .drop("_born")
        )

    store.write_snapshot("nodes", stamped("nodes", code_graph.build_nodes(files, entities), ["id"]), snapshot)
    edges = code_graph.build_edges(entities)
    store.write_snapshot("edges", stamped("edges", edges, ["from_id", "to_id", "relationship_name"]), snapshot)
    fresh_nodes = store.written("nodes", snapshot)
    store.write_snapshot("vectors", index_vectors(fresh_nodes, embed), snapshot)

    counted = fresh_nodes.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("entity_count"))
    fresh_state = (
        touched.join(counted, FILE_KEY, "left")
        .withColumns({
            "entity_count": F.coalesce("entity_count", F.lit(0)), "content_hash": F.col("new_hash"),
            "deleted": F.lit(False), "data_snapshot": F.lit(snapshot), "last_indexed_at": now,
        })
    )
    gone = differences.filter("status = 'deleted'").withColumns({"deleted": F.lit(True), "last_indexed_at": now})
    # A file that was only touched keeps its rows; its new time spares the next run a look.
    stored = store.current("file_state", repo_ids)
    renewed = differences.filter("status = 'unchanged'").select(*FILE_KEY, F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    renewed = stored.join(renewed, FILE_KEY).filter("not (size <=> _size and modified <=> _modified)")
    renewed = renewed.withColumns({"size": F.col("_size"), "modified": F.col("_modified"), "last_indexed_at": now})
    state = materialised(
        conform(fresh_state, FILE_STATE).unionByName(conform(gone, FILE_STATE)).unionByName(conform(renewed, FILE_STATE))
    )
    store.write_snapshot("file_state", state, snapshot)

    # The commit comes last; one row per repository of this run.
    paths = spark.createDataFrame(list(roots.items()), "repo_id string, repo_path string")
    changed = state.select(*FILE_KEY, "entity_count", F.lit(1).alias("_wave")).unionByName(
        stored.select(*FILE_KEY, "entity_count", F.lit(0).alias("_wave"))
    )
    deleted = state.filter("deleted").select(*FILE_KEY)
    kept = changed.join(deleted, FILE_KEY, "left_anti").groupBy(*FILE_KEY).agg(F.max_by("entity_count", "_wave").alias("entity_count"))
    totals = kept.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_files"), F.sum("entity_count").alias("total_entities"))
    placed = state.groupBy("repo_id").agg(F.collect_set(store.bucket()).alias("buckets"))
    commits = (
        paths.join(totals, "repo_id", "left")
        .join(placed, "repo_id", "left")
        .join(found.trees, "repo_id", "left")
        .withColumns({
            "total_files": F.coalesce("total_files", F.lit(0)), "total_entities": F.coalesce("total_entities", F.lit(0)),
            "buckets": F.coalesce("buckets", F.array().cast("array<int>")),
            "snapshot": F.lit(snapshot), "kind": F.lit("delta"), "indexed_at": now,
        })
    )
    store.append("repo_state", conform(commits, REPO_STATE))
    store.compact(store.crowded(settings.store_deltas, repo_ids))

    fresh_totals = counted.groupBy("repo_id").agg(F.sum("entity_count").alias("fresh_entities"))
    counters = (
        paths.join(snapshots.counters(differences), "repo_id", "left")
        .join(fresh_totals, "repo_id", "left")
        .na.fill(0)
        .withColumnRenamed("fresh_entities", "total_entities")
    )
    errors = found.problems.select(
        *FILE_KEY, F.concat("file_path", F.lit(": "), "reason").alias("message")
    )
    return snapshot, index_report(counters, errors), found.problems
