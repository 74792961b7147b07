"""Nearest indexed ancestor of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.functions.paths import path_prefixes


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """Deepest of ``roots.root`` that is the path itself or one of its parents.

    Each path is expanded to its prefixes (as many as it has components) and
    equi-joined; the deepest match is taken by a map-side combinable aggregate.
    """
    candidates = paths.select(
        "path", F.posexplode(path_prefixes(F.col("path"))).alias("_depth", "root")
    )
    found = candidates.join(roots.select("root").distinct(), "root")
    best = found.groupBy("path").agg(F.max_by("root", "_depth").alias("root"))
    return paths.select("path").distinct().join(best, "path", "left")
