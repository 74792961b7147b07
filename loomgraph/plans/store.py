"""Indexed tables on shared storage, merged while they are read.

A run writes a snapshot: the rows of the files it made anew, and a file-state row for each
file it judged differently, a tombstone for one that is gone. Rows lie in folders
``repo_id / snapshot / bucket``, the bucket a hash of the file's path, so a refresh writes
what it touched and nothing else. One row in ``repo_state`` commits the snapshot; without
it nothing of a failed or cancelled run is visible, and nothing is overwritten while read.

Readers see the committed snapshots of each bucket from its last compaction on. A file's
newest state names the snapshot that holds its rows; rows of its other snapshots are
dropped by an anti join with those few pairs. Compaction rewrites a bucket's visible rows
as one snapshot, which hides the ones before it; vacuum removes what is hidden.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.schema import EDGES, FILE_STATE, NODES, TOOL_CALLS, VECTORS, conform
from loomgraph.settings import Settings

STAMPED = ", created_at timestamp, updated_at timestamp"
REPO_STATE = (
    "repo_id string, repo_path string, snapshot string, kind string, buckets array<int>, "
    "total_files bigint, total_entities bigint, indexed_at timestamp, "
    "tree_files bigint, tree_digest bigint, tree_newest bigint"
)
TABLES = {
    "nodes": NODES + STAMPED,
    "edges": EDGES + STAMPED,
    "vectors": VECTORS,
    "file_state": FILE_STATE,
    "repo_state": REPO_STATE,
    "tool_calls": TOOL_CALLS,
}
SORTED_BY = {
    "nodes": ["id"],
    "edges": ["from_id"],
    "vectors": ["collection", "id"],
    "file_state": ["file_path"],
}
DATA_TABLES = ("nodes", "edges", "vectors")
SNAPSHOT_TABLES = (*DATA_TABLES, "file_state")
_FILE = ["repo_id", "file_path"]
_PLACE = ["repo_id", "snapshot", "bucket"]


def new_snapshot() -> str:
    """A name that sorts after those given before it."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class CodeStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = Settings.store_buckets):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def bucket(self, file_path: str = "file_path") -> Column:
        return F.pmod(F.xxhash64(file_path), F.lit(self.buckets)).cast("int")

    def _read(self, table: str, repo_ids: list[str] | None = None) -> DataFrame:
        """All rows ever written and not removed, of the named repositories' folders or all."""
        ddl = TABLES[table] + (", snapshot string, bucket int" if table in SNAPSHOT_TABLES else "")
        folders = [self.path(table)] if repo_ids is None else [f"{self.path(table)}/repo_id={r}" for r in repo_ids]
        rows = self.spark.createDataFrame([], ddl)
        for folder in folders:
            # A damaged usage log counts as empty; every other table must be whole.
            tolerant = str(table == "tool_calls").lower()
            reader = self.spark.read.schema(ddl).option("ignoreCorruptFiles", tolerant)
            try:
                found = reader.option("basePath", self.path(table)).parquet(folder)
            except Exception as error:  # nothing written yet
                if "PATH_NOT_FOUND" not in str(error):
                    raise
                continue
            rows = found if len(folders) == 1 else rows.unionByName(found)
        return rows

    # --- what is visible ------------------------------------------------------------

    def repo_state(self) -> DataFrame:
        """The newest state row of every repository."""
        rows = self._read("repo_state").filter("kind = 'delta'").drop("kind", "buckets")
        values = [c for c in rows.columns if c != "repo_id"]
        newest = rows.groupBy("repo_id").agg(F.max_by(F.struct(*values), F.col("snapshot")).alias("_newest"))
        return newest.select("repo_id", "_newest.*").select(*rows.columns)

    def visible(self) -> DataFrame:
        """(repo_id, snapshot, bucket) that readers see: per bucket the last compaction and what came after."""
        commits = self._read("repo_state").select("repo_id", "snapshot", "kind", F.explode("buckets").alias("bucket"))
        from_ = F.max(F.when(F.col("kind") == "base", F.col("snapshot")))
        grouped = commits.groupBy("repo_id", "bucket").agg(from_.alias("_from"), F.collect_set("snapshot").alias("_all"))
        seen = F.filter("_all", lambda s: s >= F.coalesce("_from", F.lit("")))
        return grouped.select("repo_id", F.explode(seen).alias("snapshot"), "bucket")

    def _visible_rows(self, table: str, repo_ids: list[str] | None) -> DataFrame:
        """Rows in visible folders. For named repositories the folders are a filter on partition
        columns; for all of them the join prunes folders at run time."""
        if repo_ids is None:
            return self._read(table).join(self.visible(), _PLACE, "left_semi")
        # Folders of the named repositories, bounded by snapshots between compactions times buckets.
        places: dict[tuple[str, str], list[int]] = {}
        for row in self.visible().filter(F.col("repo_id").isin(*repo_ids)).collect():
            places.setdefault((row.repo_id, row.snapshot), []).append(row.bucket)
        rows = self._read(table, sorted({repo for repo, _ in places}))
        inside = F.lit(False)
        for (repo, snapshot), buckets in sorted(places.items()):
            inside = inside | ((F.col("repo_id") == repo) & (F.col("snapshot") == snapshot) & F.col("bucket").isin(*sorted(buckets)))
        return rows.filter(inside)

    def _file_log(self, repo_ids: list[str] | None) -> DataFrame:
        """Per file its newest state, and the snapshots that hold rows of it."""
        log = self._visible_rows("file_state", repo_ids)
        values = [c for c in log.columns if c not in _FILE]
        return log.groupBy(*_FILE).agg(
            F.max_by(F.struct(*values), F.col("snapshot")).alias("_newest"),
            F.collect_set("data_snapshot").alias("_held"),
        )

    def superseded(self, repo_ids: list[str] | None = None) -> DataFrame:
        """(repo_id, file_path, snapshot) whose rows a newer state of the file replaces or deletes."""
        newest = F.when(~F.col("_newest.deleted"), F.col("_newest.data_snapshot"))
        stale = F.filter("_held", lambda s: ~s.eqNullSafe(F.col("_current")))
        return self._file_log(repo_ids).withColumn("_current", newest).select(*_FILE, F.explode(stale).alias("snapshot"))

    def current(self, table: str, repo_ids: list[str] | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows as of the newest commit, optionally of some repositories or buckets only."""
        if table == "file_state":
            log = self._file_log(repo_ids).select(*_FILE, "_newest.*").filter("not deleted")
            rows = conform(log.withColumn("bucket", self.bucket()), f"{FILE_STATE}, bucket int")
        else:
            rows = self._visible_rows(table, repo_ids)
            if buckets is not None:
                rows = rows.filter(F.col("bucket").isin(*buckets))
            rows = rows.join(self.superseded(repo_ids), [*_FILE, "snapshot"], "left_anti")
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(*buckets))
        return rows.select(*[c.split(" ", 1)[0] for c in TABLES[table].split(", ")])

    # --- writing --------------------------------------------------------------------

    def write_snapshot(self, table: str, rows: DataFrame, snapshot: str) -> None:
        """Write rows under a snapshot name, in the folders of their files' buckets.

        Rebalancing gives even files however uneven the repositories are; the
        order inside a file lets lookups skip row groups.
        """
        (
            rows.withColumn("snapshot", F.lit(snapshot))
            .withColumn("bucket", self.bucket())
            .hint("rebalance", "repo_id", "bucket")
            .sortWithinPartitions("repo_id", "bucket", *SORTED_BY[table])
            .write.mode("append")
            .partitionBy(*_PLACE)
            .parquet(self.path(table))
        )

    def written(self, table: str, snapshot: str) -> DataFrame:
        """The rows of one snapshot, committed or not."""
        return self._read(table).filter(F.col("snapshot") == snapshot).drop("snapshot", "bucket")

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(table))

    def clear(self, table: str) -> None:
        self.spark.createDataFrame([], TABLES[table]).write.mode("overwrite").parquet(self.path(table))

    # --- upkeep ---------------------------------------------------------------------

    def crowded(self, most: int, repo_ids: list[str] | None = None) -> dict[str, list[int]]:
        """Buckets per repository that have more than ``most`` snapshots."""
        counted = self.visible().groupBy("repo_id", "bucket").count().filter(F.col("count") > most)
        if repo_ids is not None:
            counted = counted.filter(F.col("repo_id").isin(*repo_ids))
        found: dict[str, list[int]] = {}
        for row in counted.collect():  # one row per repository and bucket
            found.setdefault(row.repo_id, []).append(row.bucket)
        return {repo: sorted(b) for repo, b in found.items()}

    def compact(self, crowded: dict[str, list[int]]) -> str | None:
        """Rewrite the visible rows of the given buckets as one snapshot; its name.

        Not to be run while a run is indexing the same repository.
        """
        if not crowded:
            return None
        repos, snapshot = sorted(crowded), new_snapshot()
        wanted = F.lit(False)
        for repo, buckets in crowded.items():
            wanted = wanted | ((F.col("repo_id") == repo) & self.bucket().isin(*buckets))
        for table in DATA_TABLES:
            self.write_snapshot(table, self.current(table, repos).filter(wanted), snapshot)
        state = self.current("file_state", repos).filter(wanted).withColumn("data_snapshot", F.lit(snapshot))
        self.write_snapshot("file_state", state, snapshot)
        commits = self.spark.createDataFrame([(r, b) for r, b in sorted(crowded.items())], "repo_id string, buckets array<int>")
        commits = commits.withColumns({"snapshot": F.lit(snapshot), "kind": F.lit("base"), "indexed_at": F.current_timestamp()})
        self.append("repo_state", conform(commits, REPO_STATE))
        return snapshot

    def vacuum(self, older_than_seconds: float = 86_400.0) -> int:
        """Remove folders that no reader can see any more; how many.

        Folders younger than the given age stay, for readers that began before a compaction
        and for runs that have not committed yet.
        """
        limit = f"{time.time_ns() - int(older_than_seconds * 1e9):020d}"
        gateway = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        configuration = self.spark.sparkContext._jsc.hadoopConfiguration()
        seen, removed = self.visible(), 0
        for table in SNAPSHOT_TABLES:
            places = self._read(table).select(*_PLACE).distinct()
            gone = places.filter(F.col("snapshot") < limit).join(seen, _PLACE, "left_anti")
            for row in gone.toLocalIterator():  # folder names
                folder = gateway.Path(f"{self.path(table)}/repo_id={row.repo_id}/snapshot={row.snapshot}/bucket={row.bucket}")
                removed += bool(folder.getFileSystem(configuration).delete(folder, True))
        return removed
