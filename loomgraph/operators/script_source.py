"""JavaScript and TypeScript definitions, imports, exports and calls from lines of code."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.operators.source_text import (
    FILE_KEY,
    SCRIPT_KEYWORDS,
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

_NAME = r"[A-Za-z_$][\w$]*"
_FUNCTION = rf"\b(?:async\s+)?function\s+({_NAME})"
_CLASS = rf"\b(?:abstract\s+)?class\s+({_NAME})"
_INTERFACE = rf"\binterface\s+({_NAME})"
_TYPE = rf"\btype\s+({_NAME})\s*(?:<[^=]*>)?\s*=(?![=>])"
_BINDING = rf"\b(?:const|let)\s+({_NAME})\s*(?::(?:[^=]|=>)+?)?=(?![=>])"
_METHOD = (
    r"^\s*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*"
    r"(?!(?:" + "|".join(SCRIPT_KEYWORDS) + r")\b)"
    rf"({_NAME})\s*(?:<[^>(]*>)?"
)
_METHOD_HEAD = _METHOD + r"(?=\()"
# A signature with a type after its parameters: `name(a: A): B`, no call.
_TYPED_SIGNATURE = _METHOD + r"\((?:[^()]|\([^()]*\))*\)\s*:"
_IMPORT = r"^\s*import\b(?!\s*[(.])"
_REEXPORT = r"^\s*export\s*(?:type\s*)?[*{]"
_TOKEN = "|".join(
    p.replace("(" + _NAME + ")", _NAME)
    for p in (_IMPORT, _REEXPORT, _FUNCTION, _CLASS, _INTERFACE, _TYPE, _BINDING, _METHOD_HEAD)
) + r"|=>(?=\s*\{)|=>|[(){};]"


_TOKENS = re.compile(same_in_python(_TOKEN))
# On a line without these words only method heads, arrows and brackets can match.
_WORDS = re.compile("import|export|function|class|interface|type|const|let")
_BARE_TOKENS = re.compile(same_in_python(_METHOD_HEAD.replace("(" + _NAME + ")", _NAME)) + r"|=>|[(){};]")
_KINDS = [
    (re.compile(same_in_python(pattern)), kind)
    for pattern, kind in (
        (_IMPORT, "import"),
        (_REEXPORT, "reexport"),
        (_FUNCTION, "function"),
        (_CLASS, "class"),
        (_INTERFACE, "interface"),
        (_TYPE, "type_alias"),
        (_BINDING, "binding"),
    )
]
_EXPORT = re.compile(same_in_python(r"^\s*export\b"))


def _token_kind(token: str) -> str | None:
    if token == "=>" or token in "(){};":
        return None
    return next((kind for pattern, kind in _KINDS if pattern.search(token)), "method")


_SIGNATURE, _HEAD, _OPENS = (
    re.compile(same_in_python(p)) for p in (_TYPED_SIGNATURE, _METHOD_HEAD, r"\{\s*\Z")
)


def _line_calls(code: str) -> list[str]:
    """Call targets of a line; the name of a method being defined is not called by it."""
    targets = call_targets(code, SCRIPT_KEYWORDS)
    head = _HEAD.search(code) if targets else None
    defines = head and (
        _SIGNATURE.search(code) or (_OPENS.search(code) and code.count("(") == code.count(")"))
    )
    return [t for t in dict.fromkeys(targets) if t != head[1]] if defines else targets


_DEFINITION = (
    "line int, idx int, kind string, level int, end_line int, token string, exported boolean, comment_above string, "
    "first3 array<string>, _head_raw string, _head_code string, calls array<string>, _class_token string"
)
_BODIED = ("function", "class", "interface", "method")


def _extents(tokens: list[tuple]) -> Iterator[tuple]:
    """Each definition's place, kind, nesting, last line and the line its body begins on.

    ``tokens`` are ``line, idx, token, kind, string_line, at`` in order. Opening and closing
    brackets of one nesting level alternate, so the body of a definition lies between
    the next two of its own level.
    """
    nested, braces, parens = [], 0, 0
    for item in tokens:
        token = item[2]
        level, paren = braces, parens
        if token in "{}":
            braces += 1 if token == "{" else -1
            level = min(level, braces)
        elif token in "()":
            parens += 1 if token == "(" else -1
            paren = min(paren, parens)
        nested.append((level, paren, *item))
    # Of each nesting the next token, next lines of "{", "}" and "=>", and next end of a statement.
    ahead: dict[tuple[int, int], tuple] = {}
    # Of tokens at one place, as texts under one path have them, the first follows the others.
    backwards = sorted(nested, key=lambda t: (-t[2], -t[3]))
    for level, paren, line, idx, token, kind, string_line, at in backwards:
        following, opened, closed, arrow, stop = ahead.get((level, paren), (None,) * 5)
        if kind:
            is_arrow = kind == "binding" and following == "=>"
            ended = line if stop is None else stop
            body, end, valid = line, ended, True
            if kind in _BODIED:
                body, end = opened, closed
                valid = following == "{" if kind == "method" else opened is not None
            elif is_arrow:
                body = arrow
                end = closed if opened == arrow else max(ended, arrow)
            elif kind in ("binding", "type_alias") and following == "{":
                end = closed
            elif kind in ("import", "reexport"):
                body = end = string_line
            if valid:
                named = "arrow" if is_arrow else "variable" if kind == "binding" else kind
                yield (
                    line, idx, named, level, line if end is None else end,
                    token, line if body is None else body, at,
                )
        if token not in "()":
            ahead[level, paren] = (
                token,
                line if token == "{" else opened,
                line if token == "}" else closed,
                line if token == "=>" else arrow,
                None if kind else line if token == ";" else stop,
            )


def _definition_rows(lines: list[Line], outline: bool) -> Iterator[tuple]:
    """One row per definition with its header, and one per line that calls something.

    An ``outline`` has no calls, and headers of imports alone.
    """
    string_line, string_lines = None, [None] * len(lines)
    for at in range(len(lines) - 1, -1, -1):
        string_line = lines[at].line if "~" in lines[at].code else string_line
        string_lines[at] = string_line
    tokens, comments, first_of = [], [], {}
    above = Line(0, "", "~", None)
    for at, here in enumerate(lines):
        found = (_TOKENS if _WORDS.search(here.code) else _BARE_TOKENS).findall(here.code)
        tokens += [(here.line, n, t, _token_kind(t), string_lines[at], at) for n, t in enumerate(found)]
        comments.append(None if above.code.strip(" ") else above.comment)
        first_of.setdefault(here.line, at)
        if not outline and (called := _line_calls(here.code)):
            yield (here.line, len(found), *[None] * 9, called)
        above = here if here.raw.strip(" ") else above
    tokens.sort(key=lambda t: t[:2])
    heads_of = sorted(_extents(tokens))
    for n, (line, idx, kind, level, end, token, body, at) in enumerate(heads_of):
        exported = bool(_EXPORT.search(lines[at].code))
        if outline and kind not in ("import", "reexport"):
            yield (line, idx, kind, level, end, token, exported, *[None] * 5)
            continue
        # The header goes up to the body or the next definition, whose lines are its own.
        after = n + 1
        while after < len(heads_of) and [heads_of[after][i] for i in (0, 1, 6)] == [line, idx, body]:
            after += 1  # the same definition in another text under this path
        until = min(body, heads_of[after][0] - 1) if after < len(heads_of) else body
        start = stop = first_of[line]
        while stop < len(lines) and lines[stop].line <= until:
            stop += 1
        yield (
            line, idx, kind, level, end, token, exported, comments[at], first_lines(lines, at),
            "\n".join(x.raw for x in lines[start:stop]), "\n".join(x.code for x in lines[start:stop]), None,
        )


def _with_class(rows: list[tuple]) -> Iterator[tuple]:
    """Rows with the head of the class whose body holds a method directly."""
    items = sorted((row[1], row[2], at, row) for at, row in enumerate(rows) if row[3] in ("class", "method"))
    items = [(at, row) for _, _, at, row in items]
    found = enclosing_places([(row[1], row[5], row[3] == "class") for _, row in items])
    class_of = {}
    for n, outer in found.items():
        at, row = items[n]
        if outer is not None and row[3] == "method" and row[4] == items[outer][1][4] + 1:
            class_of[at] = items[outer][1][6]
    for at, row in enumerate(rows):
        yield (*row, class_of.get(at))


def script_entities(files: DataFrame, outline: bool = False) -> DataFrame:
    """Entity rows (calls included, not yet distinct) of JavaScript and TypeScript files; see ``parse_files`` for ``outline``."""
    return _describe(file_rows(files, partial(_definition_rows, outline=outline), _with_class, _DEFINITION), outline)


def _describe(headed: DataFrame, outline: bool) -> DataFrame:
    kind, raw, code = F.col("kind"), F.col("_head_raw"), F.col("_head_code")
    filled = lambda c: F.nullif(c, F.lit(""))
    none = F.array().cast("array<string>")
    is_import = kind.isin("import", "reexport")
    is_callable = kind.isin("function", "arrow", "method")
    name = F.when(kind == "function", F.regexp_extract("token", _FUNCTION, 1))
    for k, pattern in (
        ("class", _CLASS), ("interface", _INTERFACE), ("type_alias", _TYPE), ("arrow", _BINDING),
        ("variable", _BINDING), ("method", _METHOD),
    ):
        name = name.when(kind == k, F.regexp_extract("token", pattern, 1))
    quoted = F.regexp_extract_all(raw, F.lit(r"""["']([^"'\n]*)["']"""), F.lit(1))
    lines = F.col("end_line") - F.col("line") + 1
    comment = strip(F.rtrim(F.ltrim(F.col("comment_above"), F.lit("/*")), F.lit("*/")))
    headed = (
        headed.withColumn("_name", name)
        .withColumn("_module", F.when(is_import, F.try_element_at(quoted, F.lit(-1))))
        .withColumn(
            "_clause",
            F.when(
                kind == "import",
                F.regexp_extract(code, r"(?s)\bimport\s+(?:type\s+)?(.*?)(?:\bfrom\b|$)", 1),
            ),
        )
        .withColumn("_default", F.regexp_extract("_clause", rf"^\s*({_NAME})\s*(?:,|$|\s)", 1))
        .withColumn("_named", F.regexp_extract("_clause", r"(?s)\{(.*)\}", 1))
        .withColumn("_params", F.when(is_callable, _parameters(code, raw)))
        .withColumn("_sign", F.when(~is_import, signature(F.col("first3"), lines)))
        .withColumn("_has_source", F.when(is_import, raw.rlike(r"(?s)\bfrom\s*[\"']")))
    )
    token_name, module, clause, default = (
        F.col("_name"), F.col("_module"), F.col("_clause"), F.col("_default"),
    )
    named_list = F.filter(
        F.transform(
            F.split("_named", ","), lambda n: F.regexp_extract(n, rf"^\s*(?:type\s+)?({_NAME})", 1)
        ),
        lambda n: n != "",
    )
    imported = F.when(default != "", F.concat(named_list, F.array(default))).otherwise(named_list)
    exported, params, has_source = F.col("exported"), F.col("_params"), F.col("_has_source")
    ahead = r"^\s*(?:export\s+(?:default\s+)?)?(?:declare\s+)?"
    sign = F.regexp_replace("_sign", ahead, "")
    returned = filled(
        strip(
            F.regexp_extract(
                F.substring(raw, params["stop"] + 1, F.length(raw)),
                r"(?s)^\s*(:.*?)\s*(?:=>|\{[^{}]*$)",
                1,
            )
        )
    )
    bases = strip(F.regexp_extract(code, r"(?s)\bextends\s+([\w$.]+)", 1))
    span = {"start_line": F.col("line"), "end_line": F.col("end_line")}
    detailed = lambda **details: {} if outline else details
    callable_own = entity(
        kind=kind, name=token_name, **span,
        **detailed(
            signature=sign, parameters=params["text"], return_type=returned,
            docstring=F.when(kind != "arrow", comment),
        ),
    )
    class_own = entity(
        kind=kind, name=token_name, **span, **detailed(signature=sign, docstring=comment, bases=filled(bases))
    )
    plain_own = entity(kind=kind, name=token_name, **span, **detailed(signature=sign))
    variable_own = entity(
        kind=kind, name=token_name, **span,
        **detailed(
            signature=F.substring_index(sign, "\n", 1),
            type_annotation=filled(strip(F.regexp_extract("token", r"(?s)(:.*)=$", 1))),
        ),
    )
    import_own = entity(
        kind=kind, name=module, **span, signature=strip(raw), source_module=module,
        imported_names=imported, is_default=default != "", is_namespace=clause.contains("*"),
    )
    reexport_own = entity(
        kind=F.lit("export"), name=module, **span, signature=strip(raw), source_module=module,
        export_kind=F.lit("re-export"),
    )
    export = entity(
        kind=F.lit("export"), name=token_name, **span, export_kind=F.lit("named"),
        **detailed(signature=F.col("_sign")),
    )
    calls = entities() if outline else F.transform(F.coalesce("calls", none), lambda t: call_entity(F.col("line"), t))
    own = (
        F.when(kind.isin("function", "arrow", "method"), entities(callable_own))
        .when(kind == "class", entities(class_own))
        .when(kind == "variable", entities(variable_own))
        .when(kind == "reexport", F.when(has_source, entities(reexport_own)).otherwise(entities()))
        .when(
            kind == "import",
            F.when(clause.rlike(r"\S") & has_source, entities(import_own)).otherwise(entities()),
        )
        .when(kind.isNotNull(), entities(plain_own))
        .otherwise(entities())
    )
    is_exported = (
        exported & (F.col("idx") == 0) & kind.isNotNull() & ~kind.isin("method", "import", "reexport")
    )
    rows = F.concat(own, F.when(is_exported, entities(export)).otherwise(entities()), calls)
    found = headed.withColumn("_rows", rows).select(
        *FILE_KEY, "language", "idx", "_class_token", F.posexplode_outer("_rows").alias("_n", "_e")
    ).filter("_e is not null").select(*FILE_KEY, "language", "idx", "_class_token", "_n", "_e.*")
    kept = found.filter((F.col("kind") != "method") | F.col("_class_token").isNotNull())
    if not outline:
        # The first line of a method whose parameters span lines is not a call of its name.
        same_name = Window.partitionBy(*FILE_KEY, "start_line", "name")
        defines = F.max((F.col("kind") == "method").cast("int")).over(same_name) == 1
        kept = kept.withColumn("_defines", defines).filter(
            (F.col("kind") != "call") | F.col("call_target").contains(".") | ~F.col("_defines")
        )
    order = ("function", "arrow", "class", "method", "interface", "type_alias", "import", "export", "call")
    rank = F.lit(len(order))
    for n, k in reversed(list(enumerate(order))):
        rank = F.when(F.col("kind") == k, n).otherwise(rank)
    return kept.select(
        *FILE_KEY,
        "language",
        (
            rank.cast("bigint") * (1 << 56)
            + F.col("start_line").cast("bigint") * (1 << 32)
            + F.col("idx") * (1 << 12)
            + F.col("_n")
        ).alias("ordinal"),
        F.when(F.col("kind") == "arrow", 1).when(F.col("kind") == "method", 2).otherwise(0).alias("call_rank"),
        "name", "kind", "start_line", "end_line", "signature", "docstring", "parameters",
        "return_type",
        F.when(F.col("kind") == "method", F.regexp_extract("_class_token", _CLASS, 1)).alias("parent_name"),
        "bases", "source_module", "imported_names", "is_default", "is_namespace", "export_kind",
        "call_target", "type_annotation",
    )


def _parameters(code: Column, raw: Column) -> Column:
    """Text and end position of the parameter list of a header.

    The list starts at the first parenthesis after the name (or the ``=`` of an
    arrow function) and ends at the last closing one before the body.
    """
    binding = code.rlike(r"(?s)\b(?:const|let)\b[^(]*=\s*(?:async\s*)?(?:<[^>(]*>\s*)?\(")
    first = F.when(
        binding,
        F.length(F.regexp_extract(code, r"(?s)^(.*?=\s*(?:async\s*)?(?:<[^>(]*>\s*)?)\(", 1)),
    ).otherwise(F.length(F.regexp_extract(code, r"(?s)^(.*?)\(", 1)))
    tail = F.substring(code, first + 1, F.length(code))
    inside = F.length(
        F.regexp_extract(tail, r"(?s)^(\((?:[^()]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))*\))", 1)
    )
    return F.struct(
        F.substring(raw, first + 1, inside).alias("text"), (first + inside).alias("stop")
    )
