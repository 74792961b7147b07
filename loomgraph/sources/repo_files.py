"""Source trees as a table: one row per entry, content only where it is needed.

Spark's own file sources skip names that begin with ``_`` or ``.``, which would lose
package initialisers and ignore files. Here the driver names roots only: a tree's
directories are a frontier that tasks list level by level, and files are read by tasks
after predicates on names and sizes have thinned them out. What can't be listed or read is
a row that says why.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.functions.paths import EXTENSION_TO_LANGUAGE, file_name, suffix
from loomgraph.operators.discovery import ENTRY_FILES, EXCLUDED_DIRS
from loomgraph.schema import FILES
from loomgraph.session import materialised, work_partitions

#: Files that are read whatever their size: they say how others are treated.
MARKER_NAMES = (".gitignore", "package.json", "manage.py", "alembic.ini", *ENTRY_FILES)

ENTRIES = (
    "repo_id string, root string, path string, relative_path string, kind string, "
    "size bigint, modified bigint, reason string"
)
_ENTRY_SCHEMA = pa.schema(
    [(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (c.split() for c in ENTRIES.split(", "))]
)
_DIRS_PER_TASK = 64
_FILES_PER_BATCH = 256
_BYTES_PER_BATCH = 16 << 20


def repo_id(path: str) -> str:
    return hashlib.sha256(os.path.realpath(path).encode()).hexdigest()[:16]


def list_directory(repo: str, root: str, directory: str) -> Iterator[dict]:
    """The entries of one directory; excluded directories and links to directories are left out."""

    def entry(path: str, kind: str, size=None, modified=None, reason=None) -> dict:
        relative = os.path.relpath(path, root)
        return dict(repo_id=repo, root=root, path=path, relative_path="" if relative == "." else relative,
                    kind=kind, size=size, modified=modified, reason=reason)

    try:
        with os.scandir(directory) as found:
            children = sorted(found, key=lambda e: e.name)
    except OSError as error:
        yield entry(directory, "directory", reason=f"unreadable: {error.strerror}")
        return
    for child in children:
        try:
            if child.is_dir():
                if child.name not in EXCLUDED_DIRS and not child.is_symlink():
                    yield entry(child.path, "directory")
            elif child.is_file():
                stat = child.stat()
                yield entry(child.path, "file", stat.st_size, stat.st_mtime_ns // 1000)
        except OSError as error:
            yield entry(child.path, "file", reason=f"unreadable: {error.strerror}")


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rows = list(list_directory(row["repo_id"], row["root"], row["path"]))
            for begin in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[begin : begin + 10_000], _ENTRY_SCHEMA)


def list_trees(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row per directory and file below the roots, and one more, with its reason, for
    each directory that can't be listed. One job per level of the deepest tree.
    """
    real = sorted({os.path.realpath(r) for r in roots})
    frontier = spark.createDataFrame(
        [(repo_id(r), r, r) for r in real], "repo_id string, root string, path string"
    )
    width, levels = len(real), []
    while width:
        # Listing costs far more than its rows weigh: spread by count, not by size.
        tasks = max(1, min(work_partitions(spark), -(-width // _DIRS_PER_TASK)))
        level = materialised(frontier.repartition(tasks).mapInArrow(_list, ENTRIES))
        levels.append(level)
        frontier = level.filter("kind = 'directory' and reason is null").select("repo_id", "root", "path")
        width = frontier.count()
    entries = spark.createDataFrame([], ENTRIES)
    for level in levels:
        entries = entries.unionByName(level)
    return entries


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, contents, reasons, held = [], [], [], 0

        def filled():
            some = batch.take(pa.array(rows, pa.int64()))
            columns = [c for c in some.schema.names if c not in ("content", "reason")]
            return pa.RecordBatch.from_arrays(
                [*(some.column(c) for c in columns), pa.array(contents, pa.large_binary()).cast(pa.binary()), pa.array(reasons, pa.string())],
                [*columns, "content", "reason"],
            )

        for at, (path, known) in enumerate(zip(batch.column("path").to_pylist(), batch.column("reason").to_pylist())):
            content, reason = None, known
            if reason is None:
                try:
                    with open(path, "rb") as file:
                        content = file.read()
                except OSError as error:
                    reason = f"unreadable: {error.strerror}"
            rows.append(at)
            contents.append(content)
            reasons.append(reason)
            held += len(content or b"")
            if held >= _BYTES_PER_BATCH or len(rows) >= _FILES_PER_BATCH:
                yield filled()
                rows, contents, reasons, held = [], [], [], 0
        if rows:
            yield filled()


def with_contents(files: DataFrame) -> DataFrame:
    """``files`` (path, reason and any other columns) with their content, read where no reason
    speaks against it; a failed read is a reason."""
    kept = [f for f in files.schema.fields if f.name not in ("content", "reason")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    columns = files.select(*(f.name for f in kept), "reason")
    return columns.mapInArrow(_read, f"{ddl}, content binary, reason string")


def is_marker(relative_path) -> "F.Column":
    """Whether a file tells of frameworks or ignored paths: known names, in the root or below its children."""
    return file_name(relative_path).isin(*MARKER_NAMES) & (F.size(F.split(relative_path, "/")) <= 2)


def marker_listing(entries: DataFrame) -> DataFrame:
    """The files of ``entries`` as a listing with the contents of marker files only."""
    files = entries.filter("kind = 'file'")
    marker = is_marker(F.col("relative_path"))
    names = [c.split()[0] for c in FILES.split(", ")]
    rest = files.filter(~marker).withColumn("content", F.lit(None).cast("binary"))
    return with_contents(files.filter(marker)).select(*names).unionByName(rest.select(*names))


def read_repositories(spark: SparkSession, roots: list[str], max_file_size_kb: int | None = None) -> DataFrame:
    """Listing of the given source trees (see :mod:`loomgraph.operators.discovery`), with the
    contents of source files up to the size, if one is given, and of all marker files."""
    files = list_trees(spark, roots).filter("kind = 'file'")
    path = F.col("relative_path")
    source = suffix(path).isin(*EXTENSION_TO_LANGUAGE)
    if max_file_size_kb is not None:
        source = source & (F.col("size") <= max_file_size_kb * 1024)
    wanted = source | is_marker(path)
    names = [c.split()[0] for c in FILES.split(", ")]
    rest = files.filter(~wanted).withColumn("content", F.lit(None).cast("binary"))
    return with_contents(files.filter(wanted)).select(*names).unionByName(rest.select(*names))
