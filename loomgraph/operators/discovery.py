"""Which files of a listing are source code worth indexing.

A listing has ``repo_id, path, relative_path, size, content``. All predicates are
columns; per-repository rules (frameworks, ignore file) are one small row per
repository, joined on ``repo_id``.
"""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from loomgraph.functions.paths import EXTENSION_TO_LANGUAGE, file_name, language_of, suffix
from loomgraph.operators.source_text import decoded
from loomgraph.settings import MAX_FILE_SIZE_KB

# Directories never indexed.
EXCLUDED_DIRS = (
    # dependencies and caches
    "node_modules", "bower_components", "site-packages", "__pycache__", ".eggs", ".egg-info",
    ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", ".git",
    # build outputs
    "dist", "build", "out", "output", ".output", "target",
    ".next", ".nuxt", ".svelte-kit", ".turbo", ".parcel-cache", ".cache", "coverage", ".nyc_output",
    "staticfiles", "static_root", "static_collected", "staticfiles_collected",
    # editors, platforms, package managers
    ".idea", ".vscode", ".gradle", ".cargo", ".vercel", ".serverless", ".aws-sam", ".firebase",
    ".netlify", ".amplify", "cdk.out", ".yarn", ".pnp", ".pnpm-store",
    "logs", "temp", "tmp", "storybook-static", ".storybook", "typings",
)
# File names and extensions never indexed, and endings of minified files.
EXCLUDED_NAMES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "bun.lock",
    "next-env.d.ts", "react-app-env.d.ts", "staticfiles.json", "webpack-stats.json",
    "script.py.mako",
)
EXCLUDED_EXTENSIONS = (
    ".mo", ".pot", ".snap", ".map", ".tsbuildinfo", ".db", ".sqlite", ".sqlite3", ".pid", ".log",
    ".lock",
)
MINIFIED_ENDINGS = (".min.js", ".min.css", ".bundle.js", ".chunk.js")
MINIFIED_SINGLE_LINE_BYTES = 1000
MINIFIED_MEAN_LINE_BYTES = 500
# Framework -> directories it adds to the excluded ones, and name globs (none so far).
FRAMEWORK_DIRS = {
    "django": ("migrations", "locale", "fixtures", "media", "uploads", "webpack_bundles"),
    "flask": ("instance", "migrations", "uploads"),
    "fastapi": ("alembic", "migrations"),
    "alembic": ("alembic", "migrations"),
    "react": ("public", ".swc", ".babel_cache"),
    "nextjs": ("public",),
    "nuxtjs": ("public",),
    "nestjs": (".prisma",),
    "express": ("public", "uploads", "seeders"),
    "node": (),
}
FRAMEWORK_GLOBS: dict[str, tuple[str, ...]] = {}
# Entry files and text marks that give a framework away.
ENTRY_FILES = ("app.py", "main.py", "wsgi.py", "application.py")
PACKAGE_MARKS = {
    '"react"': "react",
    '"next"': "nextjs",
    '"nuxt"': "nuxtjs",
    '"@nestjs/core"': "nestjs",
    '"express"': "express",
}


def repo_markers(listing: DataFrame) -> DataFrame:
    """(repo_id, frameworks, ignore_text) from marker files in the root and its children.

    Every marker row votes for the frameworks it shows. The few distinct votes of
    a repository and its one ignore file are combined map-side in a single pass.
    """
    parts = F.split("relative_path", "/")
    depth, name = F.size(parts), file_name(F.col("relative_path"))
    child = ~F.get(parts, F.lit(0)).isin(*EXCLUDED_DIRS)
    at_root = (depth == 1) | ((depth == 2) & child)

    def has_dir(directory: str) -> Column:
        return ((depth >= 2) & (F.get(parts, F.lit(0)) == directory)) | (
            (depth >= 3) & child & (F.get(parts, F.lit(1)) == directory)
        )

    text = decoded(F.col("content"))
    entry = at_root & name.isin(*ENTRY_FILES)
    head = F.lower(text)
    package = at_root & (name == "package.json")
    votes = [
        F.when(at_root & (name == "manage.py"), F.lit("django")),
        F.when(entry & F.contains(head, F.lit("flask")), F.lit("flask")),
        F.when(entry & F.contains(head, F.lit("fastapi")), F.lit("fastapi")),
        F.when((at_root & (name == "alembic.ini")) | has_dir("alembic"), F.lit("alembic")),
        F.when(has_dir("instance"), F.lit("flask")),
        F.when(package, F.lit("node")),
        *[
            F.when(package & F.contains(text, F.lit(mark)), F.lit(framework))
            for mark, framework in PACKAGE_MARKS.items()
        ],
    ]
    ignore_file = F.col("relative_path") == ".gitignore"
    marked = listing.filter(
        ignore_file
        | (at_root & name.isin("manage.py", "alembic.ini", "package.json", *ENTRY_FILES))
        | has_dir("alembic")
        | has_dir("instance")
    )
    return (
        marked.groupBy("repo_id")
        .agg(
            F.collect_set(F.array_compact(F.array(*votes))).alias("_votes"),
            F.max(F.when(ignore_file, text)).alias("ignore_text"),
        )
        .withColumn("frameworks", F.array_sort(F.array_distinct(F.flatten("_votes"))))
        .drop("_votes")
    )


def detect_frameworks(listing: DataFrame) -> DataFrame:
    """(repo_id, frameworks) of the repositories that show any framework."""
    return (
        repo_markers(listing).filter(F.size("frameworks") > 0).select("repo_id", "frameworks")
    )


def framework_dirs(frameworks: Column) -> Column:
    """Extra excluded directories of a set of frameworks."""
    table = F.create_map(
        *[
            item
            for name, dirs in FRAMEWORK_DIRS.items()
            for item in (F.lit(name), F.array(*[F.lit(d) for d in dirs]).cast("array<string>"))
        ]
    )
    empty = F.array().cast("array<string>")
    return F.array_distinct(
        F.flatten(
            F.transform(
                F.coalesce(frameworks, empty),
                lambda f: F.coalesce(F.try_element_at(table, f), empty),
            )
        )
    )


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """Path regex of one ignore-file line and whether it re-includes; None for no rule."""
    line = pattern.rstrip("\r\n")
    if not line.endswith("\\ "):
        line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    if not line.strip("/"):
        return None
    below_only = line.endswith("/")
    anchored = "/" in line.rstrip("/")
    segments = [s for s in line.strip("/").split("/") if s]
    if not anchored:
        segments.insert(0, "**")
    out = "^"
    for position, segment in enumerate(segments):
        last = position == len(segments) - 1
        if segment == "**":
            out += ".+" if last else "(?:.+/)?"
            below_only = below_only and not last
        else:
            out += _segment_regex(segment) + ("" if last else "/")
    if segments[-1] != "**":
        out += "/.*" if below_only else "(?:/.*)?"
    return out + "$", negated


def _segment_regex(segment: str) -> str:
    out, i = "", 0
    while i < len(segment):
        char = segment[i]
        i += 1
        if char == "*":
            out += "[^/]*"
        elif char == "?":
            out += "[^/]"
        elif char == "\\" and i < len(segment):
            out += re.escape(segment[i])
            i += 1
        elif char == "[" and "]" in segment[i + 1 :]:
            end = segment.index("]", i + 1)
            body = segment[i:end]
            negation = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[&^])", r"\\\1", body[1:] if negation else body)
            out += "[" + ("^" if negation else "") + body + "]"
            i = end + 1
        else:
            out += re.escape(char)
    return out


_RULES = T.ArrayType(
    T.StructType(
        [T.StructField("regex", T.StringType()), T.StructField("negated", T.BooleanType())]
    )
)


@F.pandas_udf(_RULES)
def ignore_rules(texts: pd.Series) -> pd.Series:
    def compiled(text: str | None) -> list[dict]:
        rules = (ignore_regex(line) for line in (text or "").split("\n"))
        return [{"regex": r[0], "negated": r[1]} for r in rules if r]

    return texts.map(compiled)


def is_ignored(path: Column, rules: Column) -> Column:
    """Last matching rule decides. Rules stay an array on the row, no pairs are formed."""
    matching = F.filter(rules, lambda r: F.rlike(path, r["regex"]))
    return F.coalesce(~F.try_element_at(matching, F.lit(-1))["negated"], F.lit(False))


def is_minified(relative_path: Column, content: Column) -> Column:
    """Minified or generated: telling name, one giant line, or long lines on average."""
    name = F.lower(file_name(relative_path))
    by_name = F.lit(False)
    for ending in MINIFIED_ENDINGS:
        by_name = by_name | name.endswith(ending)
    size = F.octet_length(content)
    text = content.cast("string")
    lines = size - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    return (
        by_name
        | ((lines <= 1) & (size > MINIFIED_SINGLE_LINE_BYTES))
        | (size / lines > MINIFIED_MEAN_LINE_BYTES)
    )


def discover(
    listing: DataFrame,
    languages: list[str] | None = None,
    max_file_size_kb: int = MAX_FILE_SIZE_KB,
) -> DataFrame:
    """Rows of ``listing`` to index, with their language.

    ``languages`` names languages; ``typescript`` includes TSX files.
    """
    small = listing.filter(F.col("size") <= max_file_size_kb * 1024)
    named = named_sources(small, repo_rules(listing), languages)
    return named.filter(~is_minified(F.col("relative_path"), F.col("content"))).select(
        "repo_id", "path", "relative_path", "language", "size", "content"
    )


def named_sources(files: DataFrame, rules: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Rows of ``files`` that names and rules let through, with their language; contents don't matter."""
    wanted = set(languages or ())
    if "typescript" in wanted:
        wanted.add("tsx")
    allowed = [e for e, lang in EXTENSION_TO_LANGUAGE.items() if not wanted or lang in wanted]
    path = F.col("relative_path")
    extension, name = suffix(path), file_name(path)
    cheap = (
        extension.isin(*allowed)
        & ~extension.isin(*EXCLUDED_EXTENSIONS)
        & ~name.isin(*EXCLUDED_NAMES)
        & ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))
    )
    ruled = files.filter(cheap).join(rules, "repo_id", "left")
    no_dirs = F.array().cast("array<string>")
    kept = ruled.filter(
        ~F.arrays_overlap(F.split(path, "/"), F.coalesce("extra_dirs", no_dirs))
        & ~F.coalesce(is_ignored(path, F.col("rules")), F.lit(False))
    )
    for framework, globs in FRAMEWORK_GLOBS.items():
        for pattern in globs:
            hit = F.array_contains("frameworks", framework) & name.rlike(fnmatch.translate(pattern))
            kept = kept.filter(~F.coalesce(hit, F.lit(False)))
    return kept.select(*files.columns, language_of(path).alias("language"))


def repo_rules(listing: DataFrame) -> DataFrame:
    """Frameworks, extra excluded directories and ignore rules of each repository with any."""
    return repo_markers(listing).select(
        "repo_id",
        "frameworks",
        framework_dirs(F.col("frameworks")).alias("extra_dirs"),
        ignore_rules("ignore_text").alias("rules"),
    )
