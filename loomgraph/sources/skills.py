"""Skill documents: YAML front matter plus Markdown body, one folder per skill."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from loomgraph.functions.paths import file_name
from loomgraph.schema import SKILLS, conform

# Source -> (load order, priority added), allowed categories, name pattern.
SOURCES = {"builtin": (0, 0), "user": (1, 10), "project": (2, 20)}
CATEGORIES = ("framework", "principle", "pattern", "tool", "custom")
NAME_PATTERN = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?$"
DEFAULT_PRIORITY = 50

_FRONT = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("domains", T.ArrayType(T.StringType())),
        T.StructField("triggers", T.ArrayType(T.StringType())),
        T.StructField("priority", T.IntegerType()),
        T.StructField("depends_on", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


@F.pandas_udf(_FRONT)
def front_matter(headers: pd.Series) -> pd.DataFrame:
    """Fields of YAML headers; a header that is no mapping gives nulls."""
    import yaml

    def words(value) -> list[str]:
        if value is None:
            return []
        return [str(v) for v in (value if isinstance(value, list) else [value])]

    rows = []
    for header in headers:
        try:
            data = yaml.safe_load(header or "")
            if not isinstance(data, dict):
                raise ValueError("not a mapping")
            rows.append(
                {
                    "name": data.get("name", ""),
                    "description": data.get("description", ""),
                    "category": data.get("category", "custom"),
                    "domains": words(data.get("domains")),
                    "triggers": words(data.get("triggers")),
                    "priority": int(data.get("priority", DEFAULT_PRIORITY)),
                    "depends_on": words(data.get("depends-on")),
                    "metadata": {str(k): str(v) for k, v in (data.get("metadata") or {}).items()},
                }
            )
        except (yaml.YAMLError, ValueError, TypeError, AttributeError):
            rows.append(dict.fromkeys(_FRONT.names))
    return pd.DataFrame(rows, columns=_FRONT.names)


def read_documents(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """(path, content, source) of every ``*/SKILL.md`` below the given roots."""
    frames = None
    for source, root in roots.items():
        pattern = os.path.join(root, "*", "SKILL.md")
        if "://" not in root and not os.path.isdir(root):
            continue
        try:
            found = spark.read.text(pattern, wholetext=True)
            found = found.select(
                F.col("_metadata.file_path").alias("path"),
                F.col("value").alias("content"),
                F.lit(source).alias("source"),
            )
        except Exception as error:  # a root without any skill
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        frames = found if frames is None else frames.unionByName(found)
    if frames is None:
        return spark.createDataFrame([], "path string, content string, source string")
    return frames


def parse_skills(documents: DataFrame) -> DataFrame:
    """Skill rows of documents (path, content, source), invalid ones included with a reason.

    ``ord`` is the load order: by source, then by folder name.
    """
    parts = F.split("content", "---", 3)
    opened = F.col("content").startswith("---") & (F.size(parts) == 3)
    folder = file_name(F.substring_index("path", "/SKILL.md", 1))
    boost, order = F.lit(0), F.lit(len(SOURCES))
    for source, (position, points) in SOURCES.items():
        boost = F.when(F.col("source") == source, points).otherwise(boost)
        order = F.when(F.col("source") == source, position).otherwise(order)
    parsed = documents.withColumn(
        "_f", front_matter(F.when(opened, F.trim(F.get(parts, F.lit(1)))))
    ).select(
        "_f.*", "path", "source",
        F.btrim(F.regexp_replace(F.get(parts, F.lit(2)), r"^\s+|\s+$", "")).alias("body"),
        folder.alias("folder"), order.alias("_source_order"),
    )
    priority = F.least(F.lit(100), F.col("priority") + boost)
    return (
        parsed.withColumn("priority", F.greatest(F.lit(0), priority))
        .withColumn("invalid", invalid_reason(F.col("folder")))
        .withColumn(
            "ord",
            F.col("_source_order").cast("bigint") * (1 << 40)
            + F.pmod(F.xxhash64("folder"), F.lit(1 << 40)),
        )
    )


def invalid_reason(folder: Column | None = None) -> Column:
    """Why a skill row is rejected; null for valid rows."""
    name, description = F.col("name"), F.col("description")
    reason = (
        F.when(name.isNull(), "unreadable front matter")
        .when((name == "") | (F.length(name) > 64), "name must have 1-64 characters")
        .when(F.contains(name, F.lit("--")), "name has consecutive hyphens")
        .when(~name.rlike(NAME_PATTERN), "name must be lower-case words joined by hyphens")
        .when(
            F.coalesce(description, F.lit("")).eqNullSafe("") | (F.length(description) > 1024),
            "description must have 1-1024 characters",
        )
        .when(~F.coalesce(F.col("category"), F.lit("")).isin(*CATEGORIES), "unknown category")
        .when(F.size(F.coalesce("domains", F.array().cast("array<string>"))) == 0, "no domain")
    )
    return reason if folder is None else reason.when(name != folder, "name differs from folder")


def valid_skills(parsed: DataFrame) -> DataFrame:
    return conform(parsed.filter("invalid is null"), SKILLS)
