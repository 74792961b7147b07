"""JavaScript and TypeScript extraction on hand-written modules."""

import pytest

from loomgraph.operators.code_graph import build_edges, build_nodes
from tests.test_python_source import named, parse

SOURCE = '''\
import React, { useState, useMemo as memo } from "react";
import {
  a,
  b,
} from './ab';
import "side-effect";
import * as path from 'path';
export { x } from "./x";
export * from './y';

/** A shape. */
export interface Shape {
  area(): number;
}

export type Id = string | number;

/**
 * Adds (not a call).
 */
export function add(p: number, q = (1 + 2)): number {
  return sum(p, q);
}

// maker
export default class Circle extends Base implements Shape {
  radius = 1;
  constructor(private r: number) {
    super(r);
    this.init();
  }
  async area(): Promise<number> {
    if (this.r) { return compute(`x ${fmt(this.r)} )`); }
    const inner = (z) => z + 1;
    return 0;
  }
  static of(
    r: number,
  ): Circle {
    return new Circle(r);
  }
}

export const mul = (p: number, { q }: { q: number }): number => {
  return add(p, q) / 2;
};
const half = (p) => p / 2;
const re = /[(]"/g;
const LIMIT: number = 10;
let conf = {
  a: 1,
};
describe("x", () => {
  it("y", function () { add(1, 2); });
});
function tail() { return half(1); }
'''


@pytest.fixture(scope="module")
def rows(spark):
    return parse(spark, SOURCE, "typescript", "a.ts")[1].orderBy("ordinal").collect()


def test_kinds_and_lines(rows):
    spans = {(r.kind, r.name): (r.start_line, r.end_line) for r in rows if r.kind not in ("call", "export")}
    assert spans == {
        ("function", "add"): (21, 23),
        ("function", "tail"): (56, 56),
        ("arrow", "inner"): (34, 34),
        ("arrow", "mul"): (44, 46),
        ("arrow", "half"): (47, 47),
        ("class", "Circle"): (26, 42),
        ("method", "constructor"): (28, 31),
        ("method", "area"): (32, 36),
        ("method", "of"): (37, 41),
        ("interface", "Shape"): (12, 14),
        ("type_alias", "Id"): (16, 16),
        ("import", "react"): (1, 1),
        ("import", "./ab"): (2, 5),
        ("import", "path"): (7, 7),
        ("variable", "re"): (48, 48),
        ("variable", "LIMIT"): (49, 49),
        ("variable", "conf"): (50, 52),
    }


def test_headers(rows):
    add = named(rows, "function")["add"]
    assert (add.parameters, add.return_type) == ("(p: number, q = (1 + 2))", ": number")
    assert add.docstring == "* Adds (not a call)."
    assert add.signature.startswith("function add(")
    mul = named(rows, "arrow")["mul"]
    assert (mul.parameters, mul.return_type) == ("(p: number, { q }: { q: number })", ": number")
    circle = named(rows, "class")["Circle"]
    assert (circle.bases, circle.docstring) == ("Base", "maker")
    methods = named(rows, "method")
    assert {m.parent_name for m in methods.values()} == {"Circle"}
    assert methods["area"].return_type == ": Promise<number>"
    assert methods["of"].parameters == "(\n    r: number,\n  )"
    assert named(rows, "variable")["LIMIT"].type_annotation == ": number"


def test_imports_and_exports(rows):
    imports = named(rows, "import")
    assert imports["react"].imported_names == ["useState", "useMemo", "React"]
    assert imports["react"].is_default and not imports["./ab"].is_default
    assert imports["./ab"].imported_names == ["a", "b"]
    assert imports["path"].is_namespace
    exports = {r.name: r.export_kind for r in rows if r.kind == "export"}
    assert exports == {
        "./x": "re-export", "./y": "re-export", "Shape": "named", "Id": "named", "add": "named",
        "Circle": "named", "mul": "named",
    }


def test_calls(rows):
    assert {r.call_target for r in rows if r.kind == "call"} == {
        "sum", "this.init", "compute", "fmt", "add", "describe", "it", "half"
    }


def test_edges(spark):
    files, entities = parse(spark, SOURCE, "typescript", "a.ts")
    names = {
        r.id: (r.type, r.qualified_name or r.name or r.source_module or r.file_path)
        for r in build_nodes(files, entities).collect()
    }
    edges = {
        (names[e.from_id][1], e.relationship_name, names[e.to_id][1]) for e in build_edges(entities).collect()
    }
    assert {(a, b) for a, kind, b in edges if kind == "calls"} == {("mul", "add"), ("tail", "half")}
    assert {(a, b) for a, kind, b in edges if kind == "exports_symbol"} == {
        (n, n) for n in ("Shape", "Id", "add", "Circle", "mul")
    }
    assert ("Circle", "methods", "Circle.of") in edges


def test_plain_function_owns_a_call_before_an_arrow_does(spark):
    files, entities = parse(
        spark,
        """\
        const outer = (a) => {
          function inner() {
            return used(a);
          }
          return inner();
        };
        function used(a) { return a; }
        """,
        "javascript",
        "a.js",
    )
    names = {r.id: r.name for r in build_nodes(files, entities).collect()}
    calls = {
        (names[e.from_id], names[e.to_id])
        for e in build_edges(entities).collect()
        if e.relationship_name == "calls"
    }
    assert calls == {("inner", "used"), ("outer", "inner")}
