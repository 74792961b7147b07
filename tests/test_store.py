"""What a refresh writes, what readers see, and what is never taken for deleted."""

import os
import shutil

from loomgraph.operators import code_graph
from loomgraph.plans import index as indexing
from loomgraph.plans.engine import Engine
from loomgraph.plans.store import SNAPSHOT_TABLES, CodeStore
from loomgraph.settings import Settings
from loomgraph.sources import repo_files
from loomgraph.sources.repo_files import list_directory, list_trees, repo_id
from tests.conftest import as_set


def tree(n):
    return {f"pkg{i % 5}/mod{i}.py": f"import os\n\ndef first_{i}(a, b):\n    return second_{i}(a)\n\ndef second_{i}(x):\n    return os.getpid() + {i}\n" for i in range(n)}


def bytes_below(folder, tables=SNAPSHOT_TABLES):
    return sum(os.path.getsize(os.path.join(d, n)) for t in tables for d, _, names in os.walk(os.path.join(folder, t)) for n in names)


def test_a_refresh_writes_what_changed(spark, tmp_path, write_tree, monkeypatch):
    root, data = write_tree(tree(60)), tmp_path / "data"
    engine = Engine(spark, Settings(data_dir=str(data), store_buckets=4, store_deltas=2))
    engine.index_repository(str(root))
    before, first = bytes_below(data), {s.snapshot for s in engine.store.visible().collect()}
    names = as_set(engine.store.current("nodes"), "name")

    (root / "pkg1/mod1.py").write_text("def only():\n    return 1\n")
    engine.refresh_index()
    assert bytes_below(data) - before < before / 4
    (delta,) = {s.snapshot for s in engine.store.visible().collect()} - first
    for table in ("nodes", "edges", "vectors", "file_state"):
        assert as_set(engine.store.written(table, delta), "file_path") == {("pkg1/mod1.py",)}
    changed = names - {("first_1",), ("second_1",)} | {("only",)}
    assert as_set(engine.store.current("nodes"), "name") == changed
    assert engine.store.current("file_state").count() == 60

    # Another change, a deletion and a third snapshot in one bucket bring compaction on.
    (root / "pkg2/mod2.py").unlink()
    (root / "pkg1/mod1.py").write_text("def other():\n    return 1\n")
    engine.refresh_index()
    kept = changed - {("only",), ("first_2",), ("second_2",)} | {("other",)}
    assert as_set(engine.store.current("nodes"), "name") == kept
    assert engine.index_status(str(root)).first().total_files == 59
    assert engine.store.crowded(2) == {}
    rows = {t: as_set(engine.store.current(t), *[c for c in engine.store.current(t).columns if c in ("id", "from_id", "to_id", "file_path", "content_hash")]) for t in SNAPSHOT_TABLES}

    engine.store.compact(engine.store.crowded(0))
    after = bytes_below(data)
    assert engine.store.vacuum(3600) == 0  # nothing is old enough
    assert engine.store.vacuum(0) > 0 and bytes_below(data) < after
    for table, expected in rows.items():
        now = engine.store.current(table)
        assert as_set(now, *[c for c in now.columns if c in ("id", "from_id", "to_id", "file_path", "content_hash")]) == expected
    # All repositories at once, and buckets alone, give the same rows.
    assert as_set(engine.store.current("nodes", [repo_id(str(root))]), "id") == as_set(engine.store.current("nodes"), "id")
    parts = [as_set(engine.store.current("nodes", None, [b]), "id") for b in range(4)]
    assert sum(map(len, parts)) == engine.store.current("nodes").count()


def test_a_tree_is_read_once(spark, tmp_path, write_tree, monkeypatch):
    """Nothing of the tree is needed once the run has its table of contents."""
    root = write_tree(tree(8))
    engine = Engine(spark, Settings(data_dir=str(tmp_path / "data")))
    parse = code_graph.parse_files

    def parse_after_removal(files):
        shutil.rmtree(root)
        return parse(files)

    monkeypatch.setattr(code_graph, "parse_files", parse_after_removal)
    report = engine.index_repository(str(root)).first()
    assert report.new_files == 8 and report.errors == []
    assert as_set(engine.store.current("nodes").filter("type = 'CodeFunction'"), "name") == {(f"{p}_{i}",) for p in ("first", "second") for i in range(8)}


def test_unchanged_times_are_not_read_again(spark, tmp_path, write_tree):
    root = write_tree(tree(6))
    for name in tree(6):
        os.utime(root / name, (1_600_000_000, 1_600_000_000))
    engine = Engine(spark, Settings(data_dir=str(tmp_path / "data")))
    engine.index_repository(str(root))
    os.utime(root / "pkg3/mod3.py")  # touched, not changed
    (root / "pkg4/mod4.py").write_text("x = 1\n")
    stored = engine.store.current("file_state")
    found = indexing.compare(list_trees(spark, [str(root)]), stored, engine.settings)
    assert as_set(found.read, "file_path") == {("pkg3/mod3.py",), ("pkg4/mod4.py",)}
    assert as_set(found.differences.filter("status <> 'unchanged'"), "file_path", "status") == {("pkg4/mod4.py", "changed")}
    engine.refresh_index()
    assert engine.store.current("nodes").filter("name = 'first_3'").count() == 1
    os.utime(root / "pkg4/mod4.py", (1_600_000_000, 1_600_000_000))
    engine.refresh_index()
    again = indexing.compare(list_trees(spark, [str(root)]), engine.store.current("file_state"), engine.settings)
    assert "pkg4/mod4.py" not in {r.file_path for r in again.read.collect()}


def test_skipped_is_not_deleted(spark, tmp_path, write_tree):
    root = write_tree({"a.py": "def a(): pass\n", "deep/b.py": "def b(): pass\n", "c.py": "def c(): pass\n", "d.py": "def d(): pass\n", "big.py": "def e(): pass\n"})
    engine = Engine(spark, Settings(data_dir=str(tmp_path / "data"), max_file_size_kb=1))
    engine.index_repository(str(root))
    names = as_set(engine.store.current("nodes"), "name")
    (root / "a.py").unlink()
    os.symlink("a.py", root / "a.py")  # a link to itself can't be read
    (root / "c.py").unlink()
    (root / "big.py").write_text("# long\n" * 500)
    report = engine.refresh_index().first()
    assert (report.deleted_files, report.skipped_files, report.unchanged_files) == (1, 2, 2)
    assert len(report.errors) == 2 and report.errors[0].startswith("a.py: unreadable") and report.errors[1] == "big.py: larger than 1 KB"
    assert as_set(engine.problems, "file_path") == {("a.py",), ("big.py",)}
    assert as_set(engine.store.current("nodes"), "name") == names - {("c",)}

    # A directory that can't be listed hides its files, which stay as they are.
    entries = list_trees(spark, [str(root)]).filter("relative_path not like 'deep%'").collect()
    blind = (repo_id(str(root)), str(root), f"{root}/deep", "deep", "directory", None, None, "unreadable: Permission denied")
    entries = spark.createDataFrame([*map(tuple, entries), blind], repo_files.ENTRIES)
    run = indexing.index(engine.store, entries, {repo_id(str(root)): str(root)}, settings=engine.settings)
    assert run.report.first().deleted_files == 0 and ("deep: unreadable: Permission denied") in run.report.first().errors
    assert ("b",) in as_set(engine.store.current("nodes"), "name")


def test_unlisted_directories_are_rows(tmp_path, monkeypatch):
    def refuse(path):
        raise PermissionError(13, "Permission denied")

    monkeypatch.setattr(repo_files.os, "scandir", refuse)
    (row,) = list_directory("r", str(tmp_path), str(tmp_path / "x"))
    assert (row["kind"], row["relative_path"], row["reason"]) == ("directory", "x", "unreadable: Permission denied")


def test_store_without_commits_is_empty(spark, tmp_path):
    store = CodeStore(spark, str(tmp_path / "none"))
    assert store.current("nodes").count() == 0 and store.current("nodes", ["r"]).count() == 0
    assert store.visible().count() == 0 and store.compact(store.crowded(0)) is None and store.vacuum(0) == 0
