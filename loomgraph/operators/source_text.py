"""From file contents to lines of code ready for pattern matching.

String and comment contents are blanked by one small helper, because a tokenising
regex with a replacement callback has no JVM counterpart. Lengths and line breaks
are kept, so positions in the blanked text are positions in the source. Where
statements and bodies begin and end is marked in the same pass over a file's lines;
everything after that is columns and windows over the rows it makes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomgraph.session import work_partitions

FILE_KEY = ["repo_id", "file_path"]
SIGNATURE_LINES = 3
_ROWS_SENT = 5_000


class Line(NamedTuple):
    """A physical line: number, source text, blanked code, comment that ends on it."""

    line: int
    raw: str
    code: str
    comment: str | None


# Blanked text: '~' stands for string characters, '`' for those after a line
# break inside a string, blanks for comments.
_PYTHON = re.compile(
    r"(?P<comment>\#[^\n]*)"
    r"|(?P<text>(?:(?<!\w)[rbufRBUF]{1,2})?(?:"
    r'"""(?:\\.|[^\\])*?(?:"""|\Z)'
    r"|'''(?:\\.|[^\\])*?(?:'''|\Z)"
    r'|"(?:\\.|[^"\\\n])*"?'
    r"|'(?:\\.|[^'\\\n])*'?))",
    re.S,
)
_SCRIPT = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r'|(?P<text>"(?:\\.|[^"\\\n])*"'
    r"|'(?:\\.|[^'\\\n])*'"
    r"|`(?:\\.|\$\{(?:[^{}]|\{[^{}]*\})*\}|[^`\\])*`)"
    r"|(?P<before>(?:[(,=:\[!&|?{};]|\breturn\b|\bcase\b)\s*)"
    r"(?P<regex>/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)",
    re.S,
)
_HOLE = re.compile(r"\$\{([^{}`]*)\}")


def _fill(text: str) -> str:
    head, newline, tail = text.partition("\n")
    return "~" * len(head) + (newline + re.sub(r"[^\n]", "`", tail) if newline else "")


def _blank_python(match: re.Match) -> str:
    text = match.group()
    return " " * len(text) if match.lastgroup == "comment" else _fill(text)


def _blank_script(match: re.Match) -> str:
    text = match.group()
    if match["comment"]:
        return re.sub(r"[^\n]", " ", text)
    if match["regex"]:
        return match["before"] + "~" * len(match["regex"])
    if text[0] != "`":
        return _fill(text)
    filled, code = list(_fill(text)), _HOLE.finditer(text)
    for hole in code:  # template holes stay code
        filled[hole.start(1) : hole.end(1)] = text[hole.start(1) : hole.end(1)]
    return "".join(filled)


_BLANKED = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("comments", T.ArrayType(T.StringType())),
    ]
)


def blank(text: str, language: str) -> tuple[str, list[str | None]]:
    """Text with strings and comments blanked, and the script comment that ends on each line."""
    if language == "python":
        return _PYTHON.sub(_blank_python, text), []
    ends: list[str | None] = [None] * (text.count("\n") + 1)
    line, at = 0, 0

    def blanked_match(match: re.Match) -> str:
        nonlocal line, at
        if match["comment"]:
            line += text.count("\n", at, match.end())
            at = match.end()
            ends[line] = match["comment"]
        return _blank_script(match)

    return _SCRIPT.sub(blanked_match, text), ends


@F.pandas_udf(_BLANKED)
def blanked(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
    pairs = [blank(text or "", language) for text, language in zip(texts, languages)]
    return pd.DataFrame(pairs, columns=["code", "comments"])


def same_in_python(pattern: str) -> str:
    r"""A JVM pattern for Python's ``re``: ``\s`` and ``\w`` stand for ASCII there."""
    in_class = lambda c: c.replace(r"\s", " \t\n\x0b\f\r").replace(r"\w", "a-zA-Z0-9_")
    return re.sub(
        r"\[(?:\\.|[^\]\\])*\]|\\[sw]",
        lambda m: in_class(m.group() if m.group()[0] == "[" else f"[{m.group()}]"),
        pattern,
    )


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 with malformed sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def line_count(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("int")


def enclosing_places(items: Sequence[tuple[int, int, bool]]) -> dict[int, int | None]:
    """The place of the innermost interval strictly around each item of one file, where there is one.

    Items are ``(start, end, is an interval)`` in file order, others are points at their start.
    As in ``with_enclosing``, the last interval opened one level further out is the one around.
    """
    events = [(start, 0 if spans else 1, -end, at) for at, (start, end, spans) in enumerate(items)]
    events += [(end, 2, -end, at) for at, (_, end, spans) in enumerate(items) if spans]
    depth, opened, found = 0, {}, {}
    for _, step, _, at in sorted(events):
        if step == 2:
            depth -= 1
            continue
        if depth >= 1:
            found[at] = opened.get(depth)
        if step == 0:
            depth += 1
            opened[depth] = at
    return found


def file_rows(
    files: DataFrame,
    rows_of: Callable[[list[Line]], Iterator[tuple]],
    owned: Callable[[list[tuple]], Iterator[tuple]],
    columns: str,
) -> DataFrame:
    """The rows that ``rows_of`` makes of each file's lines, as ``columns`` after file and language.

    ``files`` has ``repo_id, file_path, language, text``. Texts under one path count
    as one file whose lines meet by number, and whose rows, language first, meet in ``owned``.
    The size limit on files bounds every list.
    """
    # One kind of line end, so that a carriage return is neither code nor text.
    ended = F.when(F.contains("text", F.lit("\r")), F.regexp_replace("text", "\r\n?", "\n")).otherwise(F.col("text"))
    whole = (
        files.select(*FILE_KEY, "language", ended.alias("text"))
        .repartition(work_partitions(files.sparkSession), *FILE_KEY)
        .groupBy(*FILE_KEY)
        .agg(F.sort_array(F.collect_list(F.struct("language", "text"))).alias("texts"))
    )
    head = ", ".join(f"{name} {files.schema[name].dataType.simpleString()}" for name in (*FILE_KEY, "language"))
    schema = T.StructType.fromDDL(f"{head}, {columns}")
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow
        )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for at in range(batch.num_rows):
                *key, listed = (c[at].as_py() for c in batch.columns)
                texts: dict[str, list[str]] = {}
                for one in listed:
                    if one["text"] is not None:
                        texts.setdefault(one["language"], []).append(one["text"])
                found = [(language, *row) for language, of in texts.items() for row in rows_of(_numbered(of, language))]
                rows.extend((*key, *row) for row in owned(found))
                if len(rows) >= _ROWS_SENT:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return whole.mapInArrow(made, schema)


def _numbered(texts: list[str], language: str) -> list[Line]:
    lines = []
    for text in texts:
        raw, (code, comments) = text.split("\n"), blank(text, language)
        lines += map(Line, range(1, len(raw) + 1), raw, code.split("\n"), comments or [None] * len(raw))
    return lines if len(texts) == 1 else sorted(lines, key=lambda at: at.line)


def first_lines(lines: list[Line], at: int) -> list[str | None]:
    """The source of a line and the two after it."""
    return [lines[n].raw if n < len(lines) else None for n in range(at, at + SIGNATURE_LINES)]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def signature(first_lines: Column, lines: Column) -> Column:
    """Whole text of a definition of up to three lines, else its first three and an ellipsis."""
    text = strip(F.array_join(F.slice(first_lines, F.lit(1), F.least(lines, F.lit(SIGNATURE_LINES))), "\n"))
    return F.when(lines <= SIGNATURE_LINES, text).otherwise(F.concat(text, F.lit(" ...")))


# Keywords that may stand before an opening parenthesis.
PYTHON_KEYWORDS = (
    "if elif else while for return and or not in is lambda with assert yield except raise del "
    "await import from class def async match case"
).split()
SCRIPT_KEYWORDS = (
    "if else while for return switch catch function new await super typeof do throw delete void "
    "yield in instanceof import export class async case const let var"
).split()


_PLAIN_CALL = re.compile(
    same_in_python(r"(?<![\w.$])(?<!def )(?<!class )(?<!function )(?<!function\* )(?<!function \*)(?<!new )([A-Za-z_$][\w$]*)\s*\(")
)
_DOTTED_CALL = re.compile(
    same_in_python(r"(?<![\w.$)\]])((?:[A-Za-z_$][\w$]*(?:\([^()]*\)|\[[^\[\]]*\])*\??\.)+[A-Za-z_$][\w$]*)\s*\(")
)


def call_targets(code: str, keywords: Sequence[str]) -> list[str]:
    """Targets called on a line: plain names, then dotted ``object.method`` texts."""
    if "(" not in code:
        return []
    plain = [name for name in dict.fromkeys(_PLAIN_CALL.findall(code)) if name not in keywords]
    return plain + list(dict.fromkeys(_DOTTED_CALL.findall(code))) if "." in code else plain


# Columns every extractor fills; absent ones are null.
_ENTITY_FIELDS = {
    "kind": "string",
    "start_line": "int",
    "end_line": "int",
    "name": "string",
    "signature": "string",
    "docstring": "string",
    "parameters": "string",
    "return_type": "string",
    "bases": "string",
    "source_module": "string",
    "imported_names": "array<string>",
    "is_default": "boolean",
    "is_namespace": "boolean",
    "export_kind": "string",
    "call_target": "string",
    "type_annotation": "string",
}
_ENTITY_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in _ENTITY_FIELDS.items()) + ">"


def entity(**values: Column | None) -> Column:
    """Entity struct with the given fields; None is null."""
    defaults = {
        "signature": F.lit(""),
        "imported_names": F.array(),
        "is_default": F.lit(False),
        "is_namespace": F.lit(False),
    }
    return F.struct(
        *[
            (F.lit(None) if value is None else value).cast(kind).alias(name)
            for name, kind in _ENTITY_FIELDS.items()
            for value in (values.get(name, defaults.get(name)),)
        ]
    )


def entities(*items: Column) -> Column:
    return F.array(*items).cast(f"array<{_ENTITY_TYPE}>")


def call_entity(line: Column, target: Column) -> Column:
    return entity(
        kind=F.lit("call"),
        start_line=line,
        end_line=line,
        name=F.regexp_extract(target, r"([^.]*)$", 1),
        call_target=target,
    ).cast(_ENTITY_TYPE)
