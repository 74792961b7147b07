"""Row shapes shared by the plans, as DDL strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

FILES = (
    "repo_id string, path string, relative_path string, size bigint, modified bigint, "
    "content binary, reason string"
)

ENTITIES = (
    "repo_id string, file_path string, language string, ordinal bigint, name string, kind string, "
    "start_line int, end_line int, signature string, docstring string, parameters string, "
    "return_type string, parent_name string, bases string, source_module string, "
    "imported_names array<string>, is_default boolean, is_namespace boolean, export_kind string, "
    "call_target string, type_annotation string"
)

NODES = (
    "id string, repo_id string, type string, name string, qualified_name string, kind string, "
    "signature string, docstring string, start_line int, end_line int, file_path string, "
    "parameters string, return_type string, type_annotation string, language string, "
    "line_count int, summary string, source_module string, imported_names array<string>, "
    "is_default boolean, is_namespace boolean, import_statement string"
)

EDGES = (
    "repo_id string, file_path string, from_id string, to_id string, relationship_name string"
)

VECTORS = (
    "repo_id string, file_path string, collection string, id string, kind string, "
    "copy_key bigint, text string, embedding array<float>"
)

FILE_STATE = (
    "repo_id string, file_path string, content_hash string, language string, "
    "entity_count bigint, last_indexed_at timestamp, deleted boolean, size bigint, "
    "modified bigint, data_snapshot string"
)

TOOL_CALLS = (
    "tool string, ts timestamp, response_len bigint, result_count bigint, query string"
)

SKILLS = (
    "name string, description string, category string, domains array<string>, "
    "triggers array<string>, priority int, depends_on array<string>, body string, "
    "metadata map<string,string>, source string, path string, ord bigint"
)

# Relationship labels of the code graph.
RELATIONSHIPS = (
    "contains_symbols",
    "imports",
    "exports",
    "defined_in",
    "calls",
    "methods",
    "inherits_from",
    "resolves_to",
    "exports_symbol",
)

# Text fields that get a vector, by node type.
INDEX_FIELDS = {
    "CodeFile": ("summary", "file_path"),
    "CodeFunction": ("name", "signature", "docstring"),
    "CodeClass": ("name", "signature", "docstring"),
    "CodeImport": ("source_module", "import_statement"),
    "CodeExport": ("name",),
    "CodeVariable": ("name",),
}

# Collections consulted by a full search, by a quick search, by a name search.
SEARCH_COLLECTIONS = (
    "CodeFunction_name",
    "CodeFunction_signature",
    "CodeFunction_docstring",
    "CodeClass_name",
    "CodeClass_signature",
    "CodeClass_docstring",
    "CodeFile_file_path",
    "CodeFile_summary",
    "CodeImport_source_module",
    "CodeImport_import_statement",
    "CodeVariable_name",
)
QUICK_COLLECTIONS = (
    "CodeFunction_name",
    "CodeClass_name",
    "CodeFile_summary",
    "CodeVariable_name",
)
NAME_COLLECTIONS = tuple(c for c in SEARCH_COLLECTIONS if c.endswith("_name"))


def columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a DDL string written as above."""
    return [tuple(field.split(" ", 1)) for field in ddl.split(", ")]


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Select the columns of ``ddl`` in order, typed, with nulls for absent ones."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind).alias(name)
            for name, kind in columns(ddl)
        ]
    )
