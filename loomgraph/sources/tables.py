"""Parquet tables of a data folder, and how they stand in for code and usage data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a scan that has fewer splits than cores.

    A large table has more splits than that and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def language_suffix(lang: Column) -> Column:
    """File extension given to documents of a prose language."""
    return (
        F.when(lang == "en", ".py")
        .when(lang == "fr", ".ts")
        .when(lang == "de", ".js")
        .when(lang == "es", ".tsx")
        .otherwise(".txt")
    )


def document_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as file nodes: one repository per source, exact copies share a path."""
    docs = spread(table(spark, folder, "documents"))
    digest = F.substring(F.sha2("text", 256), 1, 16)
    return docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("repo_id"),
        F.lit("CodeFile").alias("type"),
        F.lit(None).cast("string").alias("name"),
        F.lit("file").alias("kind"),
        F.concat("lang", F.lit("/"), digest, language_suffix(F.col("lang"))).alias("file_path"),
        F.col("n_chars").cast("int").alias("start_line"),
        F.lit(0).alias("end_line"),
        F.lit("").alias("signature"),
        F.lit(None).cast("string").alias("docstring"),
        F.lit(None).cast("string").alias("import_statement"),
        F.col("text").alias("summary"),
    )


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as tool calls: one tool per event type, props as the response."""
    tool = (
        F.when(F.col("event_type") == "click", "search_code")
        .when(F.col("event_type") == "view", "find_symbol")
        .when(F.col("event_type") == "purchase", "get_dependencies")
        .when(F.col("event_type") == "signup", "get_file_summary")
        .otherwise("advise")
    )
    return table(spark, folder, "events").select(
        tool.alias("tool"),
        "ts",
        F.length("props").cast("bigint").alias("response_len"),
        F.get_json_object("props", "$.k").cast("bigint").alias("result_count"),
    )
