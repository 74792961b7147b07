"""Python definitions, imports, assignments and calls from lines of code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.operators.source_text import (
    FILE_KEY,
    PYTHON_KEYWORDS,
    Line,
    call_entity,
    call_targets,
    enclosing_places,
    entities,
    entity,
    file_rows,
    first_lines,
    same_in_python,
    signature,
    strip,
)

_DEF = r"(?s)^(\s*(?:async\s+)?def\s+)([A-Za-z_]\w*)((?:\[.*?\])?\s*)(\(.*?\))(?:(\s*->\s*)([^:]+?))?\s*:"
_CLASS = r"(?s)^(\s*class\s+)([A-Za-z_]\w*)((?:\[.*?\])?\s*)(\(.*?\))?\s*:"
_IMPORT = r"(?s)^\s*import\s+(.+)$"
_FROM = r"(?s)^\s*from\s+([.\w]+)\s+import\s+(.+)$"
_ASSIGN = r"(?s)^(\s*)([A-Za-z_]\w*)(\s*(?::\s*)?)([^=:]*?)\s*=(?!=)\s*\S"
_STRING_ONLY = r"^\s*~+(?:\n`*)*\s*$"


_KEYWORD = re.compile(same_in_python(r"^\s*(?:async\s+def|def|class|import)\s+\w"))
_MAY_BE_ENTITY = re.compile("=|def|class|import")
_HEADS = [(re.compile(p, re.ASCII), word) for p, word in ((_DEF, "def"), (_CLASS, "class"))]  # as the JVM reads them
_STATEMENT = (
    "_sid int, start_line int, stop int, block_end int, indent int, first3 array<string>, raw string, code string, "
    "_next_raw string, _next_code string, _next_indent int, calls array<struct<line:int,target:string>>, _class string"
)


def _statements(lines: list[Line]) -> list[list[int]]:
    """Statements: physical lines joined over open brackets, strings and backslashes.

    A definition keyword always starts a statement, so an unclosed bracket
    spoils no more than the statement it is in.
    """
    found: list[list[int]] = []
    opened = base = 0  # open brackets before a line are counted from the last definition keyword on
    before = ""
    for at, (_, _, code, _) in enumerate(lines):
        if _KEYWORD.search(code):
            base, starts = opened, True
        else:
            starts = bool(code.strip(" ")) and opened <= base and code[0] != "`" and not before.endswith("\\")
        if starts:
            found.append([])
        if found:
            found[-1].append(at)
        opened += sum(map(code.count, "([{")) - sum(map(code.count, ")]}"))
        before = code
    return found


def _statement_rows(lines: list[Line], outline: bool) -> Iterator[tuple]:
    """One row per statement that defines, imports or calls something, with the last line of the block it opens and the statement after it.

    A statement ends every block at its indent or deeper, up to the indent of
    the statement before it. An ``outline`` has no calls, and of the sources that of imports alone.
    """
    shaped = []
    for parts in _statements(lines):
        start, raw, code, _ = lines[parts[0]]
        stop = start
        if len(parts) > 1:
            stop = max(lines[n].line for n in parts if lines[n].code.strip(" "))
            listed = sorted(lines[n][:3] for n in parts)[: stop - start + 1]
            raw, code = "\n".join(raw for _, raw, _ in listed), "\n".join(c for _, _, c in listed)
        flat = code.replace("\t", " " * 8) if "\t" in code else code
        called, first3 = None, None
        if outline:
            raw = raw if "import" in code else None
        else:
            called = [(lines[n].line, t) for n in parts for t in call_targets(lines[n].code, PYTHON_KEYWORDS)]
            first3 = first_lines(lines, parts[0])
        shaped.append((start, stop, len(flat) - len(flat.lstrip(" ")), first3, raw, code, called))
    if not shaped:
        return
    ends: dict[int, int] = {}
    last_line = max(stop for _, stop, *_ in shaped)
    following = (None, None, None)
    for at in range(len(shaped) - 1, -1, -1):
        start, stop, indent, first3, raw, code, called = shaped[at]
        if called or _MAY_BE_ENTITY.search(code):
            yield (at + 1, start, stop, ends.get(indent, last_line), indent, first3, raw, code, *following, called)
        if at:
            _, stop_before, indent_before, *_ = shaped[at - 1]
            for level in range(indent, indent_before + 1):
                ends[level] = stop_before
        # Only a string after a definition is read.
        following = (raw, code, indent) if "~" in code and not outline else (None, None, indent)


def _with_class(rows: list[tuple]) -> Iterator[tuple]:
    """Rows with the name of the class directly around a function."""
    blocks = []
    for at, (_, sid, start, _, end, _, _, _, code, *_) in enumerate(rows):
        head = next(((word, m[2]) for pattern, word in _HEADS if word in code and (m := pattern.search(code))), None)
        if head:
            blocks.append((sid, at, start, end, *head))
    blocks.sort()
    found = enclosing_places([(start, end, True) for _, _, start, end, _, _ in blocks])
    class_of = {blocks[n][1]: blocks[o][5] for n, o in found.items() if o is not None and blocks[n][4] == "def" and blocks[o][4] == "class"}
    for at, row in enumerate(rows):
        yield (*row, class_of.get(at))


def _raw_group(pattern: str, group: int) -> Column:
    """Source text under a group of a pattern matched on the blanked code."""
    ahead = F.lit(0)
    for g in range(1, group):
        ahead = ahead + F.length(F.regexp_extract("code", pattern, g))
    return F.substring(F.col("raw"), ahead + 1, F.length(F.regexp_extract("code", pattern, group)))


def _docstring() -> Column:
    text = strip(F.col("_next_raw"))
    triple = (text.startswith('"""') & text.endswith('"""')) | (
        text.startswith("'''") & text.endswith("'''")
    )
    inner = F.substring(text, F.lit(4), F.length(text) - 6)
    bare = strip(F.btrim(F.btrim(text, F.lit('"')), F.lit("'")))
    return F.when(
        F.col("_next_code").rlike(_STRING_ONLY) & (F.col("_next_indent") > F.col("indent")),
        F.when(triple, strip(inner)).otherwise(bare),
    )


def _names(listed: Column) -> Column:
    """Names of an import list without aliases, brackets and comments."""
    flat = F.regexp_replace(listed, r"[()\\\n]", " ")
    items = F.transform(F.split(flat, ","), lambda n: F.regexp_extract(n, r"^\s*([\w.*]+)", 1))
    return F.filter(items, lambda n: n != "")


def python_entities(files: DataFrame, outline: bool = False) -> DataFrame:
    """Entity rows (calls included, not yet distinct) of Python files; see ``parse_files`` for ``outline``."""
    code = F.col("code")
    statements = file_rows(files, partial(_statement_rows, outline=outline), _with_class, _STATEMENT)
    kind = (
        F.when(code.rlike(_DEF), "function")
        .when(code.rlike(_CLASS), "class")
        .when(code.rlike(_IMPORT), "import")
        .when(code.rlike(_FROM), "from")
        .when(code.rlike(_ASSIGN), "variable")
    )
    described = statements.withColumn("_kind", kind)
    filled = lambda c: F.nullif(c, F.lit(""))
    start, statement = F.col("start_line"), strip(F.col("raw"))
    head = signature(F.col("first3"), F.col("block_end") - start + 1)
    span = {"start_line": start, "end_line": F.col("stop")}
    block = {"start_line": start, "end_line": F.col("block_end")}
    if not outline:
        block |= {"signature": head, "docstring": _docstring()}
    detail = lambda make: None if outline else make()
    module = F.regexp_extract("code", _FROM, 1)
    names = _names(F.regexp_extract("code", _FROM, 2))
    own_rows = (
        F.when(
            F.col("_kind") == "function",
            entities(
                entity(
                    kind=F.lit("function"), name=F.regexp_extract("code", _DEF, 2), **block,
                    parameters=detail(lambda: _raw_group(_DEF, 4)), return_type=detail(lambda: filled(_raw_group(_DEF, 6))),
                )
            ),
        )
        .when(
            F.col("_kind") == "class",
            entities(
                entity(
                    kind=F.lit("class"), name=F.regexp_extract("code", _CLASS, 2), **block,
                    bases=detail(lambda: filled(_raw_group(_CLASS, 4))),
                )
            ),
        )
        .when(
            F.col("_kind") == "import",
            F.transform(
                _names(F.regexp_extract("code", _IMPORT, 1)),
                lambda m: entity(
                    kind=F.lit("import"), name=m, source_module=m, signature=statement, **span
                ),
            ),
        )
        .when(
            F.col("_kind") == "from",
            entities(
                entity(
                    kind=F.lit("import"), name=module, source_module=module, signature=statement,
                    imported_names=names, is_namespace=F.array_contains(names, "*"), **span,
                )
            ),
        )
        .when(
            F.col("_kind") == "variable",
            entities(
                entity(
                    kind=F.lit("variable"), name=F.regexp_extract("code", _ASSIGN, 2), **span,
                    signature=detail(lambda: F.substring_index(statement, "\n", 1)),
                    type_annotation=detail(lambda: filled(strip(_raw_group(_ASSIGN, 4)))),
                )
            ),
        )
        .otherwise(entities())
    )
    calls = entities() if outline else F.transform("calls", lambda c: call_entity(c["line"], c["target"]))
    # Built in a projection of its own, and exploded as outer
    # rows: the filter Spark infers for an inner explode would build every array twice.
    rows = described.withColumn("_rows", F.concat(own_rows, calls)).select(
        *FILE_KEY, "language", "_sid", "_class", F.posexplode_outer("_rows").alias("_n", "_e")
    ).filter("_e is not null").select(*FILE_KEY, "language", "_sid", "_class", "_n", "_e.*")
    is_method = (F.col("kind") == "function") & F.col("_class").isNotNull()
    rank = (
        F.when(F.col("kind") == "function", 0)
        .when(F.col("kind") == "class", 1)
        .when(F.col("kind") == "import", 3)
        .when(F.col("kind") == "variable", 4)
        .otherwise(5)
    )
    return rows.select(
        *FILE_KEY,
        "language",
        (rank.cast("bigint") * (1 << 48) + F.col("_sid") * (1 << 20) + F.col("_n")).alias("ordinal"),
        F.lit(0).alias("call_rank"),
        "name",
        F.when(is_method, "method").otherwise(F.col("kind")).alias("kind"),
        "start_line", "end_line", "signature", "docstring", "parameters", "return_type",
        F.when(is_method, F.col("_class")).alias("parent_name"),
        "bases", "source_module", "imported_names", "is_default", "is_namespace", "export_kind",
        "call_target", "type_annotation",
    )
