"""Last-writer-wins merges of node, edge and state rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def merge_latest(
    rows: DataFrame, keys: Sequence[str], version: Sequence[str], created: str, updated: str
) -> DataFrame:
    """One row per key: values of the newest version, earliest created, latest updated.

    ``rows`` holds the stored and incoming rows together. ``version`` orders the
    writes of a key. All three aggregates combine map-side, so a key rewritten
    many times costs one row per map task.
    """
    values = [c for c in rows.columns if c not in {*keys, *version, created, updated}]
    merged = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.struct(*version)).alias("_latest"),
        F.min(created).alias(created),
        F.max(updated).alias(updated),
    )
    return merged.select(*keys, "_latest.*", created, updated)


def upsert(
    stored: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Column | str,
    created: str = "created_at",
    updated: str = "updated_at",
) -> DataFrame:
    """Merge a batch into a stored table; the last row of a batch wins, ``created`` is kept."""
    order = F.col(order) if isinstance(order, str) else order
    old = stored.select("*", F.lit(0).alias("_wave"), F.lit(0).cast("bigint").alias("_at"))
    new = incoming.withColumn("_at", order.cast("bigint")).withColumn("_wave", F.lit(1))
    new = new.select(*old.columns)
    return merge_latest(old.unionByName(new), keys, ["_wave", "_at"], created, updated)


def delete_files(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of files that are still there; ``gone`` has ``repo_id, file_path``."""
    return rows.join(gone.select("repo_id", "file_path").distinct(), ["repo_id", "file_path"], "left_anti")
