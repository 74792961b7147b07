"""Changes of source trees as a stream, found by modification time.

An offset is a point in time. A micro-batch covers the time since the last one. The driver
names roots only; each task walks the subtrees of a root that fall to it by name, so no
state is kept about files. A directory whose own entry list changed is reported too, which
shows deletions.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import time
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from loomgraph.sources.repo_files import list_directory, repo_id

CHANGES = "repo_id string, path string, change_type string, ts timestamp"
TASKS_PER_ROOT = 4


class Subtrees(InputPartition):
    """The ``part``-th of ``parts`` shares of a root's children; the first has the root's own files too."""

    def __init__(self, root: str, part: int, parts: int, since: float, until: float):
        self.root, self.part, self.parts, self.since, self.until = root, part, parts, since, until

    def directories(self) -> Iterator[str]:
        waiting = [self.root]
        while waiting:
            directory = waiting.pop()
            if directory != self.root or self.part == 0:
                yield directory
            for entry in list_directory("", self.root, directory):
                mine = directory != self.root or zlib.crc32(entry["relative_path"].encode("utf-8", "surrogateescape")) % self.parts == self.part
                if entry["kind"] == "directory" and entry["reason"] is None and mine:
                    waiting.append(entry["path"])


class RepoChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots = [os.path.realpath(r) for r in json.loads(options["roots"])]

    def initialOffset(self) -> dict:
        return {"until": time.time()}

    def latestOffset(self) -> dict:
        return {"until": time.time()}

    def partitions(self, start: dict, end: dict) -> list[Subtrees]:
        return [
            Subtrees(root, part, TASKS_PER_ROOT, start["until"], end["until"])
            for root in self.roots for part in range(TASKS_PER_ROOT)
        ]

    def read(self, partition: Subtrees) -> Iterator[tuple]:
        repo = repo_id(partition.root)
        for directory in partition.directories():
            try:
                changed = [(directory, "directory", os.stat(directory).st_mtime)]
                with os.scandir(directory) as entries:
                    changed += [(e.path, "modified", e.stat().st_mtime) for e in entries if e.is_file()]
            except OSError:  # gone meanwhile: its parent has changed
                continue
            for path, kind, at in changed:
                if partition.since < at <= partition.until:
                    stamp = dt.datetime.fromtimestamp(at, dt.timezone.utc)
                    yield repo, os.path.relpath(path, partition.root), kind, stamp

    def commit(self, end: dict) -> None:
        pass


class RepoChanges(DataSource):
    """``spark.readStream.format("repo_changes").option("roots", json list of folders)``."""

    @classmethod
    def name(cls) -> str:
        return "repo_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> RepoChangesReader:
        return RepoChangesReader(self.options)


def stream_changes(spark: SparkSession, roots: list[str]) -> DataFrame:
    spark.dataSource.register(RepoChanges)
    return spark.readStream.format("repo_changes").option("roots", json.dumps(list(roots))).load()
