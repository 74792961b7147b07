"""Comparison of a current file listing with the stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.operators.topk import top_k

_KEY = ["repo_id", "file_path"]
PREVIEW = 5


def diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Every path of either side with its status: new, changed, deleted or unchanged.

    Both sides have ``repo_id, file_path, content_hash``. One exchange per side
    on the path; only the keys and the hash travel.
    """
    now = current.select(*_KEY, F.col("content_hash").alias("new_hash"))
    old = stored.select(*_KEY, F.col("content_hash").alias("old_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("new_hash") != F.col("old_hash"), "changed")
        .otherwise("unchanged")
    )
    return now.join(old, _KEY, "full_outer").withColumn("status", status)


def only_new(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.join(stored.select(*_KEY), _KEY, "left_anti")


def only_deleted(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(current.select(*_KEY), _KEY, "left_anti")


def in_both(current: DataFrame, stored: DataFrame) -> DataFrame:
    return current.join(stored.select(*_KEY), _KEY, "left_semi")


def counters(differences: DataFrame) -> DataFrame:
    """Files per status and repository."""
    count = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_files")
    return differences.groupBy("repo_id").agg(
        count("new"), count("changed"), count("deleted"), count("unchanged"), count("skipped")
    )


def stale_files(differences: DataFrame) -> DataFrame:
    """The files that differ, as rows: repo_id, status, file_path; skipped ones can't be judged."""
    return differences.filter("status not in ('unchanged', 'skipped')").select("repo_id", "status", "file_path")


def staleness(differences: DataFrame, stored_totals: DataFrame | None = None) -> DataFrame:
    """One row per repository: stale flag, counts, and a five-path preview.

    The preview lists changed, then new, then deleted paths, each sorted. It is
    cut by a bounded top-k; the full lists stay rows (:func:`stale_files`).
    """
    totals = counters(differences).withColumn(
        "total_indexed", F.col("changed_files") + F.col("deleted_files") + F.col("unchanged_files")
    )
    rank = (
        F.when(F.col("status") == "changed", 0).when(F.col("status") == "new", 1).otherwise(2)
    )
    listed = top_k(
        stale_files(differences).withColumn("_rank", rank),
        ["repo_id"],
        [F.col("_rank"), F.col("file_path")],
        PREVIEW,
        spread_on="file_path",
    )
    preview = listed.groupBy("repo_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_rank", "file_path"))),
            lambda r: r["file_path"],
        ).alias("preview")
    )
    stale = F.col("new_files") + F.col("changed_files") + F.col("deleted_files")
    return (
        totals.withColumn("stale_count", stale)
        .withColumn("is_stale", (stale > 0) | (F.col("total_indexed") == 0))
        .withColumn(
            "reason",
            F.when(F.col("total_indexed") == 0, "not_indexed").when(stale > 0, "files_changed"),
        )
        .join(preview, "repo_id", "left")
        .withColumn("preview", F.coalesce("preview", F.array().cast("array<string>")))
    )


def language_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"))


def repo_totals(state: DataFrame) -> DataFrame:
    return state.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("entity_count"), F.lit(0)).cast("bigint").alias("total_entities"),
        F.max("last_indexed_at").alias("last_indexed_at"),
    )
