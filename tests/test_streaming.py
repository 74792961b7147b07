"""Debounced refreshes driven by a change stream."""

import datetime as dt
import json
import time

from loomgraph.plans.engine import Engine
from loomgraph.settings import Settings
from loomgraph.sources.repo_files import repo_id
from loomgraph.streaming.watch import Watchers, closed_bursts

CHANGES = "repo_id string, path string, change_type string, ts timestamp"


def feed(folder, name, rows):
    lines = [json.dumps(dict(zip(("repo_id", "path", "change_type", "ts"), r))) for r in rows]
    (folder / name).write_text("\n".join(lines))


def wait_for(condition, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if condition():
            return True
        time.sleep(0.3)
    return False


def test_sessions_of_a_log_close_by_its_own_time(spark, tmp_path):
    inbox = tmp_path / "changes"
    inbox.mkdir()
    base = dt.datetime(2024, 1, 1)
    at = lambda s: (base + dt.timedelta(seconds=s)).isoformat()
    feed(inbox, "1.json", [("a", "b.py", "added", at(0)), ("a", "b.py", "modified", at(1)), ("a", "b.py", "modified", at(60))])
    found = []
    stream = spark.readStream.schema(CHANGES).json(str(inbox))
    query = (
        closed_bursts(stream).writeStream.outputMode("append")
        .foreachBatch(lambda batch, _: found.extend(r.changes for r in batch.collect()))
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert found == [2]  # the change at 60 s is still open


def test_one_change_then_silence_triggers_one_refresh(spark, tmp_path, write_tree):
    root = write_tree({"a.py": "x = 1\n"})
    engine = Engine(spark, Settings(data_dir=str(tmp_path / "data")))
    engine.index_repository(str(root))
    (root / "b.py").write_text("def added(): pass\n")
    inbox = tmp_path / "changes"
    inbox.mkdir()
    repo, now = repo_id(str(root)), dt.datetime(2024, 1, 1).isoformat()
    feed(inbox, "1.json", [(repo, "b.py", "added", now), (repo, "b.py", "modified", now), ("other", "readme.md", "added", now)])
    refreshed = []

    def refresh(repos):
        engine.refresh_index(str(root))
        refreshed.append(repos)

    watchers = Watchers()
    stream = spark.readStream.schema(CHANGES).json(str(inbox))
    query = watchers.start("repo", stream, refresh, str(tmp_path / "ck"))
    try:
        assert wait_for(lambda: refreshed) and query.exception() is None
        time.sleep(4)
        assert refreshed == [[repo]]
    finally:
        watchers.stop_all()
    assert "added" in {r.name for r in engine.store.current("nodes").collect()}


def test_a_pending_burst_survives_a_restart(spark, tmp_path):
    inbox = tmp_path / "changes"
    inbox.mkdir()
    feed(inbox, "1.json", [("r", "b.py", "added", dt.datetime(2024, 1, 1).isoformat())])
    refreshed = []
    stream = spark.readStream.schema(CHANGES).json(str(inbox))
    first = Watchers()
    query = first.start("r", stream, refreshed.append, str(tmp_path / "ck"), gap_seconds=8)
    assert wait_for(lambda: query.recentProgress and any(p.numInputRows for p in query.recentProgress))
    first.stop_all()
    assert refreshed == []
    second = Watchers()
    second.start("r", spark.readStream.schema(CHANGES).json(str(inbox)), refreshed.append, str(tmp_path / "ck"), gap_seconds=8)
    try:
        assert wait_for(lambda: refreshed)
    finally:
        second.stop_all()
    assert refreshed == [["r"]]


def test_start_is_idempotent_and_stop_reports(spark, tmp_path):
    inbox = tmp_path / "changes"
    inbox.mkdir()
    stream = spark.readStream.schema(CHANGES).json(str(inbox))
    watchers = Watchers()
    first = watchers.start("repo", stream, lambda repos: None, str(tmp_path / "ck"))
    assert watchers.start("repo", stream, lambda repos: None, str(tmp_path / "ck2")) is first
    assert watchers.stop("repo") is True and watchers.stop("repo") is False
    assert not first.isActive and watchers.stop_all() == 0


def test_watching_a_tree(spark, tmp_path, write_tree):
    root = write_tree({"a.py": "x = 1\n", "b.py": "y = 1\n", "deep/er/c.py": "z = 1\n"})
    engine = Engine(spark, Settings(data_dir=str(tmp_path / "data")))
    engine.index_repository(str(root))
    query = engine.watch(str(root))
    assert engine.watch(str(root)) is query
    names = lambda: {r.name for r in engine.store.current("nodes").collect()}
    try:
        assert wait_for(lambda: query.lastProgress is not None)
        (root / "deep/er/c.py").write_text("def added(): return 1\n")  # one save
        assert wait_for(lambda: "added" in names()) and query.exception() is None
        (root / "b.py").unlink()
        assert wait_for(lambda: "y" not in names()) and query.exception() is None
    finally:
        assert engine.unwatch(str(root)) == 1
    assert engine.unwatch() == 0
