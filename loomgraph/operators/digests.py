"""Digests of directory trees: equal trees have equal digests, and a differing one says where.

A directory's digest combines those of all files below it regardless of order, so all
directories of a tree come from one aggregation, and two trees are compared from the root
down by looking only below directories whose digests differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_DIR = ["repo_id", "directory"]


def file_digest(path: Column, *facts: Column) -> Column:
    """60 bits of a file's path and facts about it."""
    text = F.concat_ws("\x1f", path, *(F.coalesce(f.cast("string"), F.lit("")) for f in facts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def directory_digests(files: DataFrame, *facts: str) -> DataFrame:
    """(repo_id, directory, depth, files, digest) of every directory with a file below it; the
    root is ''. ``files`` has repo_id, file_path and the facts that make a file what it is."""
    parts = F.split("file_path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory")))
    marked = files.select("repo_id", file_digest(F.col("file_path"), *map(F.col, facts)).alias("digest"), F.explode(above).alias("d"))
    return marked.groupBy("repo_id", "d.directory", "d.depth").agg(F.count(F.lit(1)).alias("files"), F.expr("bit_xor(digest)").alias("digest"))


def changed_directories(now: DataFrame, before: DataFrame, levels: int = 64) -> DataFrame:
    """(repo_id, directory, depth) of the deepest directories in which two sets of digests differ.

    Descends level by level: children are looked at only where the parent differs.
    Directories on one side only differ. No level is deeper than ``levels``.
    """
    both = now.select(*_DIR, "depth", "files", "digest").join(
        before.select(*_DIR, F.col("depth").alias("_depth"), F.col("files").alias("_files"), F.col("digest").alias("_digest")), _DIR, "full_outer"
    )
    unequal = both.filter("not (files <=> _files and digest <=> _digest)").select(*_DIR, F.coalesce("depth", "_depth").alias("depth"))
    frontier, found = unequal.filter("depth = 0"), None
    depth = 0
    while depth < levels and not frontier.isEmpty():
        depth += 1
        parent = F.array_join(F.slice(F.split("directory", "/"), F.lit(1), F.lit(depth - 1)), "/")
        below = unequal.filter(F.col("depth") == depth).withColumn("_parent", parent)
        below = below.join(frontier.select("repo_id", F.col("directory").alias("_parent")), ["repo_id", "_parent"])
        deepest = frontier.join(below.select("repo_id", F.col("_parent").alias("directory")).distinct(), _DIR, "left_anti")
        found = deepest if found is None else found.unionByName(deepest)
        frontier = below.drop("_parent")
    return unequal.filter("false") if found is None else found
