"""Python extraction on hand-written modules."""

import textwrap

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.code_graph import build_edges, build_nodes, parse_files
from loomgraph.operators.source_text import blanked, same_in_python

SOURCE = '''\
"""Module text."""
import os, sys as system
from .x import (
    y as z,
    w,
)
LIMIT: int = 5
NAME = "a(b)"  # call(x)

def outer(a, b: str = "x)y:", *, c=(1, 2)) -> dict[str, int]:
    """Text
    of outer.
    """
    def inner():
        return helper(a)
    value = inner()
    return value.items().map(fn(2))

async def helper(x):
    'single'
    return await outer(x)

@deco(1)
class A(Base, mixin.M):
    attr = 3

    @property
    def m(self):
        if x:
            def deep(): pass
            y = deep()
        else:
            z = 1
        # trailing comment

    def n(
        self,
        q=1,
    ):
        return self.m() + os.path.join("a", \\
            "b")

class B(A): pass
def last(): return last()
# end
'''


def parse(spark, text, language="python", path="a.py"):
    files = spark.createDataFrame(
        [("r", path, language, textwrap.dedent(text))],
        "repo_id string, file_path string, language string, text string",
    )
    return files, parse_files(files)


@pytest.fixture(scope="module")
def rows(spark):
    return parse(spark, SOURCE)[1].orderBy("ordinal").collect()


def named(rows, kind):
    return {r.name: r for r in rows if r.kind == kind}


def test_definitions_and_their_lines(rows):
    spans = {(r.kind, r.name): (r.start_line, r.end_line) for r in rows if r.kind != "call"}
    assert spans[("function", "outer")] == (10, 17)
    assert spans[("function", "inner")] == (14, 15)
    assert spans[("function", "helper")] == (19, 21)
    assert spans[("class", "A")] == (24, 41)
    assert spans[("method", "m")] == (28, 33)
    assert spans[("function", "deep")] == (30, 30)
    assert spans[("method", "n")] == (36, 41)
    assert spans[("class", "B")] == (43, 43)
    assert spans[("function", "last")] == (44, 44)


def test_headers(rows):
    outer = named(rows, "function")["outer"]
    assert outer.parameters == '(a, b: str = "x)y:", *, c=(1, 2))'
    assert outer.return_type == "dict[str, int]"
    assert outer.docstring == "Text\n    of outer."
    assert outer.signature.startswith("def outer(") and outer.signature.endswith(" ...")
    assert named(rows, "function")["helper"].docstring == "single"
    assert named(rows, "function")["inner"].signature == "def inner():\n        return helper(a)"
    methods = named(rows, "method")
    assert {methods["m"].parent_name, methods["n"].parent_name} == {"A"}
    assert methods["n"].parameters == "(\n        self,\n        q=1,\n    )"
    assert named(rows, "class")["A"].bases == "(Base, mixin.M)"


def test_imports_and_variables(rows):
    imports = named(rows, "import")
    assert set(imports) == {"os", "sys", ".x"}
    assert imports[".x"].imported_names == ["y", "w"]
    assert (imports[".x"].start_line, imports[".x"].end_line) == (3, 6)
    assert imports["os"].signature == imports["sys"].signature == "import os, sys as system"
    variables = named(rows, "variable")
    assert set(variables) == {"LIMIT", "NAME", "value", "attr", "y", "z"}
    assert variables["LIMIT"].type_annotation == "int"
    assert variables["LIMIT"].signature == "LIMIT: int = 5"


def test_calls_are_distinct_and_ignore_strings_and_comments(rows):
    targets = [r.call_target for r in rows if r.kind == "call"]
    assert len(targets) == len(set(targets))
    assert set(targets) == {
        "helper", "inner", "value.items", "value.items().map", "fn", "outer", "deco", "deep",
        "self.m", "os.path.join", "last",
    } - {"value.items"}


def test_edges(spark):
    files, entities = parse(spark, SOURCE)
    names = {
        r.id: r.qualified_name or r.name or r.source_module or r.file_path
        for r in build_nodes(files, entities).collect()
    }
    edges = {
        (names[e.from_id], e.relationship_name, names[e.to_id]) for e in build_edges(entities).collect()
    }
    calls = {(a, b) for a, kind, b in edges if kind == "calls"}
    # A call belongs to the first function around it; recursion gives no edge.
    assert calls == {("outer", "helper"), ("outer", "inner"), ("helper", "outer"), ("A.m", "deep")}
    assert {(a, b) for a, kind, b in edges if kind == "inherits_from"} == {("B", "A")}
    assert {(a, b) for a, kind, b in edges if kind == "methods"} == {("A", "A.m"), ("A", "A.n")}
    assert ("A.m", "defined_in", "A") in edges and ("outer", "defined_in", "a.py") in edges
    assert ("a.py", "imports", ".x") in edges and ("a.py", "contains_symbols", "LIMIT") in edges


def test_last_definition_of_a_name_wins(spark):
    files, entities = parse(
        spark,
        """\
        def f():
            return 1
        def f():
            return 2
        def g():
            return f()
        """,
    )
    nodes = {r.id: (r.name, r.start_line) for r in build_nodes(files, entities).collect()}
    edges = build_edges(entities).collect()
    assert [nodes[e.to_id] for e in edges if e.relationship_name == "calls"] == [("f", 3)]
    held = sorted(nodes[e.to_id] for e in edges if e.relationship_name == "contains_symbols")
    assert held == [("f", 3), ("g", 5)]


def test_broken_source_keeps_the_rest(spark):
    rows = parse(spark, "x = foo((1, 2\n\ndef ok(a):\n    return a\n\nclass C:\n    def m(self): pass\n")[1]
    found = {(r.kind, r.name) for r in rows.collect()}
    assert {("function", "ok"), ("class", "C"), ("method", "m")} <= found


def test_empty_file_and_bad_bytes(spark):
    from pyspark.sql import functions as F

    from loomgraph.operators.source_text import decoded

    files, entities = parse(spark, "")
    node = build_nodes(files, entities).first()
    assert (node.type, node.summary, node.line_count) == ("CodeFile", "Empty file", 1)
    raw = spark.createDataFrame([(b"a = '\xff'",)], "content binary")
    assert raw.select(decoded(F.col("content"))).first()[0] == "a = '\ufffd'"


def test_blanking_keeps_lengths(spark):
    frame = spark.createDataFrame(
        [("x = 'a\\'b' # c\ny = '''p\nq''' + z", "python"), ("a = `x ${f(1)} y`; // t\nb = /[(]/g", "javascript")],
        "text string, language string",
    )
    for row in frame.select("text", blanked("text", "language").code.alias("code")).collect():
        assert [len(line) for line in row.text.split("\n")] == [len(line) for line in row.code.split("\n")]
    python, script = [r.code for r in frame.select(blanked("text", "language").code.alias("code")).collect()]
    assert python == "x = ~~~~~~    \ny = ~~~~\n```` + z"
    assert script == "a = ~~~~~f(1)~~~~;     \nb = ~~~~~~"


def _entities(frame):
    return sorted(str(r.asDict(recursive=True)) for r in frame.drop("file_path", "text").collect())


@pytest.mark.parametrize("language", ["python", "typescript"])
def test_line_ends_make_no_difference(spark, language):
    from tests import test_script_source

    source = SOURCE if language == "python" else test_script_source.SOURCE
    windows, plain = (parse(spark, text, language)[1] for text in (source.replace("\n", "\r\n"), source))
    assert _entities(windows) == _entities(plain)


def test_type_parameters_and_generator_heads(spark):
    found = parse(spark, "class A[T: (int, str)](B):\n    def m(self): pass\n\ndef f[T](x: T) -> T:\n    return x\n")[1]
    assert {("class", "A"), ("method", "m"), ("function", "f")} <= {(r.kind, r.name) for r in found.collect()}
    calls = parse(spark, "function* g() {\n  yield h();\n  g();\n}\nfunction *k() {}\n", "javascript")[1].filter("kind = 'call'")
    assert {(r.name, r.start_line) for r in calls.collect()} == {("h", 2), ("g", 3)}


@pytest.mark.parametrize("language", ["python", "typescript"])
def test_only_entities_are_sorted(spark, language):
    # Windows over lines and tokens made extraction many times dearer than reading the files.
    found = parse(spark, SOURCE, language)[1]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.lstrip(" +-:").startswith("Window ") for line in plan.split("\n")) <= 8


def test_jvm_classes_in_python():
    import re

    pattern = re.compile(same_in_python(r"^\s*([\w$]+)\s"))
    assert pattern.search(" a$1\t")[1] == "a$1"
    assert not pattern.search(" a ") and not pattern.search("é ")


def test_method_names_equal_to_words_of_the_helper(spark):
    text = "class A {\n  next() {\n    stop();\n  }\n  stop(a: number) {\n    return a;\n  }\n}\nconst f = () => 1;\n"
    found = {(r.kind, r.name, r.start_line, r.end_line) for r in parse(spark, text, "javascript")[1].collect()}
    assert {("method", "next", 2, 4), ("method", "stop", 5, 7), ("arrow", "f", 9, 9)} <= found


@pytest.mark.parametrize("language", ["python", "typescript"])
def test_an_outline_has_the_same_definitions_without_shuffling_them(spark, language):
    from tests import test_script_source

    files, full = parse(spark, SOURCE if language == "python" else test_script_source.SOURCE, language)
    outline = parse_files(files, outline=True)
    columns = ["ordinal", "kind", "name", "start_line", "end_line", "parent_name", "source_module", "export_kind"]
    kept = full.filter("kind != 'call'").withColumn("import", F.when(F.col("kind") == "import", F.col("signature")))
    seen = outline.withColumn("import", F.when(F.col("kind") == "import", F.col("signature")))
    assert {tuple(r) for r in seen.select(*columns, "import").collect()} == {tuple(r) for r in kept.select(*columns, "import").collect()}
    plan = outline._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_graph_nodes_are_parsed_once_and_shuffled_only_as_files(spark, tmp_path):
    from loomgraph.catalog import REGISTERED

    part = spark.createDataFrame(
        [(i, f"name {i}", f"Brand#{i}", "TYPE", 5 + 10 * i, 1.0) for i in range(3)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    nodes = REGISTERED["build_graph_nodes"].run(spark, str(tmp_path))
    # One pass per language with no sort of entities, and no copy of the parsed files in the shared folder.
    plan = nodes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "Window" not in plan and "Join" not in plan
    owners = {r.qualified_name for r in nodes.filter("kind = 'method'").collect()}
    assert owners == {f"Part{i}.{step}{n}" for i in range(3) for n in range(1, i + 2) for step in ("step_", "step")}


def test_owners_are_found_across_texts_under_one_path(spark):
    # As windows over the path had it, a class of one text holds what stands on its lines in another.
    rows = [("r", "a.ts", "typescript", "class A {\n  m() {\n  }\n}\n"), ("r", "a.ts", "javascript", "{\n  f() {\n  }\n}\n"), ("r", "a.ts", "typescript", None)]
    files = spark.createDataFrame(rows, "repo_id string, file_path string, language string, text string")
    found = {(r.language, r.name, r.parent_name) for r in parse_files(files).filter("kind = 'method'").collect()}
    assert found == {("typescript", "m", "A"), ("javascript", "f", "A")}


def test_python_and_scripts_under_one_path_keep_their_own_calls(spark):
    rows = [("r", "a", "python", "f(1)\n\nf(2)\n"), ("r", "a", "javascript", "f(1);\nf(2);\n")]
    files = spark.createDataFrame(rows, "repo_id string, file_path string, language string, text string")
    found = parse_files(files).filter("kind = 'call'")
    assert sorted((r.language, r.call_target, r.start_line) for r in found.collect()) == [("javascript", "f", 1), ("python", "f", 1)]


@pytest.fixture
def parts(spark, tmp_path):
    part = spark.createDataFrame(
        [(i, f"name {i}", None if i == 2 else f"Brand#{i}", "TYPE", 5 + 10 * i, 1.0) for i in range(3)],
        "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_graph_totals_shuffle_entities_once_and_store_none(spark, parts):
    from loomgraph.catalog import REGISTERED

    totals = REGISTERED["graph_totals"].run(spark, parts)
    plan = totals._jdf.queryExecution().executedPlan().toString()
    # Python and script files, script definitions, all entities by file, and two for the totals; spread() adds its own.
    assert plan.count("MapInArrow") == 2 and plan.count("Exchange hashpartitioning") <= 6
    edges = REGISTERED["build_graph_edges"].run(spark, parts).collect()
    expected = {(name, sum(e.relationship == name for e in edges), len({e.file_path for e in edges if e.relationship == name})) for name in {e.relationship for e in edges}}
    assert {tuple(r) for r in totals.collect()} == expected


def test_labels_of_graph_edges_are_not_sent_to_the_driver(spark, parts):
    from loomgraph.catalog import REGISTERED

    edges = REGISTERED["build_graph_edges"].run(spark, parts)
    assert ("py/part_1.py", "Part1.step_2", "calls", "helper_2") in {tuple(r) for r in edges.collect()}
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2 and "Broadcast" not in plan
