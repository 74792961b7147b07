"""Column expressions over file paths."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, functions as F

# File extension -> language, and language filter -> path suffixes.
EXTENSION_TO_LANGUAGE = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "tsx",
    ".js": "javascript",
    ".jsx": "javascript",
}
LANGUAGE_SUFFIXES = {
    "python": (".py",),
    "typescript": (".ts", ".tsx"),
    "javascript": (".js", ".jsx"),
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased last extension; empty for dot-files and extension-less names."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def language_of(path: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for kv in EXTENSION_TO_LANGUAGE.items() for x in kv])
    return F.try_element_at(mapping, suffix(path))


def is_indexable(path: Column) -> Column:
    return suffix(path).isin(*EXTENSION_TO_LANGUAGE)


def matches_language(path: Column, language: str | None) -> Column:
    """Language filter of a code search: unknown languages and empty paths pass."""
    ends = LANGUAGE_SUFFIXES.get((language or "").lower(), ())
    if not ends:
        return F.lit(True)
    hit = F.lit(False)
    for end in ends:
        hit = hit | path.endswith(end)
    return F.coalesce(path, F.lit("")).eqNullSafe("") | hit


def matches_glob(path: Column, pattern: str | None) -> Column:
    """Shell-glob filter where ``*`` crosses ``/``; rows without a path pass."""
    if not pattern:
        return F.lit(True)
    return F.coalesce(path, F.lit("")).eqNullSafe("") | path.rlike(fnmatch.translate(pattern))


def same_file(path: Column, wanted: Column | str) -> Column:
    """Exact or suffix path match used by file summaries."""
    wanted = F.lit(wanted) if isinstance(wanted, str) else wanted
    return (path == wanted) | path.endswith(wanted)


def repo_id_of(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def path_prefixes(path: Column) -> Column:
    """All ancestor prefixes of a path, itself included, shortest first."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
