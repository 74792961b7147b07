"""Indexing, refreshing and the tools, end to end on small source trees."""

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import index as indexing
from loomgraph.plans.engine import Engine
from loomgraph.settings import Settings
from loomgraph.sources.repo_files import repo_id
from tests.conftest import as_set

TREE = {
    "pkg/__init__.py": "",
    "pkg/shapes.py": '''
        """Shapes."""
        import math

        class Shape:
            """Base of shapes."""

        class Circle(Shape):
            """A round shape."""

            def area(self):
                """Surface of the circle."""
                return square(self.r) * math.pi

        def square(x):
            return x * x
        ''',
    "web/app.ts": '''
        import { square } from "./math";

        export function double(x: number): number {
          return square(x) * 2;
        }
        ''',
    "node_modules/lib/index.js": "function hidden() { return 1; }\n",
    "notes.txt": "not source\n",
}


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, Settings(data_dir=str(tmp_path / "data")))


def test_index_then_search(engine, write_tree):
    root = write_tree(TREE)
    report = engine.index_repository(str(root)).first()
    assert (report.new_files, report.changed_files, report.deleted_files) == (3, 0, 0)
    assert report.status == "completed" and report.errors == []

    nodes = engine.store.current("nodes")
    assert as_set(nodes.filter("type = 'CodeFile'"), "file_path") == {
        ("pkg/__init__.py",), ("pkg/shapes.py",), ("web/app.ts",)
    }
    assert report.total_entities == nodes.count()

    best = engine.search_code("surface of a circle").orderBy("rank").first()
    assert best.name == "area" and best.file_path == "pkg/shapes.py"
    only_ts = engine.search_code("double number", language="typescript").collect()
    assert only_ts and all(r.file_path.endswith(".ts") for r in only_ts)
    globbed = engine.search_code("circle", file_pattern="pkg/*").collect()
    assert globbed and all(r.file_path.startswith("pkg/") for r in globbed)

    found = engine.find_symbol("Circle", kind="class").orderBy("rank").collect()
    assert found[0].name == "Circle"
    assert ("Circle", "inherits_from", "Shape") in {(r.source, r.relationship, r.target) for r in found}
    assert ("Circle", "methods", "area") in {(r.source, r.relationship, r.target) for r in found}

    assert engine.get_dependencies("Circle").count() > 0
    reached = engine.get_dependencies("Circle.area", depth=2, mode="graph")
    assert as_set(reached, "name", "depth") == {("square", 1)}
    users = engine.get_dependents("square", depth=1, mode="graph")
    assert ("area",) in as_set(users, "name")

    summary = engine.get_file_summary("shapes.py").collect()
    texts = {r.bucket: r.text for r in summary}
    assert texts["file"] == "Classes: Shape, Circle; Functions: square; Methods: area; Imports from: math"
    assert {r.name for r in summary if r.bucket == "classes"} == {"Shape", "Circle"}

    stats = engine.usage_stats().first()
    assert stats.total_calls == 8 and stats.lifetime_calls == 8
    engine.usage_reset()
    assert engine.usage_stats().first().total_calls == 0


def test_incremental_refresh(engine, write_tree):
    root = write_tree(TREE)
    engine.index_repository(str(root))
    ids = as_set(engine.store.current("nodes"), "id", "created_at")

    again = engine.refresh_index().first()
    assert (again.new_files, again.changed_files, again.deleted_files, again.unchanged_files) == (0, 0, 0, 3)
    assert as_set(engine.store.current("nodes"), "id", "created_at") == ids
    assert engine.stale_report().first().is_stale is False

    (root / "web/app.ts").unlink()
    (root / "pkg/shapes.py").write_text("def square(x):\n    return x ** 2\n")
    (root / "pkg/extra.py").write_text("LIMIT = 3\n")
    stale = engine.stale_report().first()
    assert stale.is_stale and stale.stale_count == 3
    assert stale.preview == ["pkg/shapes.py", "pkg/extra.py", "web/app.ts"]
    for tool, asked in (("search_code", "square"), ("find_symbol", "square"), ("get_dependents", "square"), ("get_file_summary", "shapes.py")):
        answer = engine.respond(tool, asked).first()
        assert answer.stale_warning == "3 file(s) changed since last index. Call refresh_index to update the knowledge base."
        assert answer.changed_files == stale.preview and answer.query == asked and answer.total == len(answer.results) > 0

    report = engine.refresh_index().first()
    assert (report.new_files, report.changed_files, report.deleted_files, report.unchanged_files) == (1, 1, 1, 1)
    answer = engine.respond("search_code", "square", top_k=2).first()
    assert answer.stale_warning is None and answer.changed_files == [] and answer.total == 2
    first = json.loads(answer.results[0])
    assert first["name"] == "square" and first["lines"] == [1, 2] and "docstring" not in first
    text = json.dumps({"results": list(map(json.loads, answer.results)), "total": 2, "query": "square"}, separators=(",", ":"))
    assert abs(engine.store._read("tool_calls").orderBy(F.desc("ts")).first().response_len - len(text)) <= 2  # digits of numbers
    nodes = engine.store.current("nodes")
    assert "web/app.ts" not in {r.file_path for r in nodes.collect()}
    assert ("Circle",) not in as_set(nodes, "name") and ("LIMIT",) in as_set(nodes, "name")
    assert {r.file_path for r in engine.store.current("vectors").collect()} == {
        "pkg/__init__.py", "pkg/extra.py", "pkg/shapes.py"
    }
    assert engine.store.current("edges").filter("file_path = 'web/app.ts'").isEmpty()

    (root / "pkg/extra.py").unlink()
    whole = engine.index_repository(str(root), incremental=False).first()
    assert (whole.new_files, whole.deleted_files) == (2, 1)
    assert "pkg/extra.py" not in {r.file_path for r in engine.store.current("nodes").collect()}


def test_an_unchanged_tree_is_settled_by_its_digest(engine, write_tree, monkeypatch):
    root = write_tree(TREE)
    for folder, _, names in os.walk(root):
        for name in names:
            os.utime(os.path.join(folder, name), (1_600_000_000, 1_600_000_000))
    engine.index_repository(str(root))
    monkeypatch.setattr(indexing, "staleness", None)  # not needed
    assert engine.stale_warning() is None
    monkeypatch.undo()
    (root / "new.py").write_text("x = 1\n")
    assert engine.stale_warning()["changed_files"] == ["new.py"]


def test_language_filter_keeps_other_languages(engine, write_tree):
    root = write_tree(TREE)
    engine.index_repository(str(root))
    report = engine.index_repository(str(root), languages=["typescript"]).first()
    assert (report.deleted_files, report.unchanged_files) == (0, 1)
    assert engine.store.current("file_state").count() == 3


def test_status_and_several_repositories(engine, write_tree):
    one = write_tree(TREE, "one")
    two = write_tree({"main.js": "const f = (a) => a;\nf(1);\n"}, "two")
    engine.index_repository([str(one), str(two)])
    assert engine.index_status().count() == 2
    status = engine.index_status(str(one)).first()
    assert status.indexed and status.total_files == 3
    assert status.languages == {"python": 2, "typescript": 1}
    assert engine.index_status("/nowhere").first().indexed is False
    both = {repo_id(str(one)), repo_id(str(two))}
    assert {r.repo_id for r in engine.search_code("function", top_k=30).collect()} == both  # all of the call
    engine.active = str(two)
    assert {r.repo_id for r in engine.search_code("function", top_k=30).collect()} == {repo_id(str(two))}
    engine.active = None  # no active repository: search all
    repos = {r.repo_id for r in engine.search_code("function", top_k=30).collect()}
    assert repos == {repo_id(str(one)), repo_id(str(two))}


def test_second_run_on_a_busy_repository_is_refused(engine, write_tree, monkeypatch):
    root = write_tree(TREE)
    started, release = threading.Event(), threading.Event()

    def slow(*args):
        started.set()
        release.wait(30)
        raise RuntimeError("stopped")

    monkeypatch.setattr(indexing, "_run", slow)
    outcome = []

    def work():
        try:
            engine.index_repository(str(root))
        except RuntimeError as error:
            outcome.append(str(error))

    thread = threading.Thread(target=work)
    thread.start()
    assert started.wait(30) and indexing.is_indexing()
    with pytest.raises(indexing.IndexBusyError):
        engine.index_repository(str(root))
    assert engine.cancel_indexing() == {"status": "cancelling"}
    release.set()
    thread.join()
    assert outcome == ["stopped"] and not indexing.is_indexing()
    assert engine.cancel_indexing() == {"status": "idle"}


def test_failed_run_leaves_nothing_visible(engine, write_tree, monkeypatch):
    root = write_tree(TREE)
    engine.index_repository(str(root))
    before = as_set(engine.store.current("nodes"), "id")
    (root / "pkg/shapes.py").write_text("x = 1\n")
    write = engine.store.write_snapshot

    def failing(table, rows, snapshot):
        if table == "vectors":
            raise OSError("disk full")
        write(table, rows, snapshot)

    monkeypatch.setattr(engine.store, "write_snapshot", failing)
    with pytest.raises(OSError):
        engine.refresh_index()
    assert as_set(engine.store.current("nodes"), "id") == before
    assert engine.stale_report().first().is_stale


SKILL = """---
name: {name}
description: {description}
category: framework
domains: [{domains}]
triggers: [{triggers}]
depends-on: [{depends}]
priority: {priority}
---
Body of {name}.
"""


def test_advice(spark, tmp_path, write_tree):
    def skill(name, description, domains="django", triggers="", depends="", priority=50):
        return SKILL.format(**locals())

    builtin = write_tree(
        {
            "django-models/SKILL.md": skill("django-models", "Model fields and migrations", "django, orm", "model field", "query-sets"),
            "query-sets/SKILL.md": skill("query-sets", "Lazy evaluation of lookups", "orm"),
            "react-hooks/SKILL.md": skill("react-hooks", "State in function components", "react"),
            "wrong-name/SKILL.md": skill("other-name", "Folder differs"),
            "no-front/SKILL.md": "no front matter",
        },
        "builtin",
    )
    repo = write_tree(
        {
            "manage.py": "import django\n",
            ".loomgraph/skills/react-hooks/SKILL.md": skill("react-hooks", "Project rules for hooks", "react"),
        },
        "app",
    )
    settings = Settings(data_dir=str(tmp_path / "data"), builtin_skills_dir=str(builtin))
    engine = Engine(spark, settings)
    engine.active = str(repo)
    listed = engine.list_skills().collect()
    assert [r.name for r in listed] == ["django-models", "query-sets", "react-hooks"]
    assert {r.name: (r.source, r.priority) for r in listed}["react-hooks"] == ("project", 70)

    found = engine.advise("add a model field", top_k=1).orderBy("rank").collect()
    assert [r.name for r in found] == ["django-models", "query-sets"]
    assert found[0].content == "Body of django-models." and found[1].content is None
    assert any(r.startswith("trigger match: 'model field'") for r in found[0].reasons)
    assert "framework match: {'django'}" in found[0].reasons
    assert found[1].reasons == ["dependency of django-models"]
    with pytest.raises(RuntimeError):
        engine.with_settings(advisor_enabled=False).list_skills()
