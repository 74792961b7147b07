"""Projection of nodes into search results and of results into responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RELEVANCE_DIGITS = 3
ERROR_LIMIT = 20


def node_result() -> list[Column]:
    """Result columns of a hydrated hit (node columns plus ``distance``)."""
    blank = F.lit("")
    return [
        F.col("id"),
        F.coalesce(F.col("name"), F.col("file_path"), blank).alias("name"),
        F.coalesce(F.col("kind"), F.col("type"), blank).alias("kind"),
        F.coalesce(F.col("file_path"), blank).alias("file_path"),
        F.coalesce(F.col("start_line"), F.lit(0)).alias("start_line"),
        F.coalesce(F.col("end_line"), F.lit(0)).alias("end_line"),
        F.coalesce(F.col("signature"), blank).alias("signature"),
        F.col("docstring"),
        F.col("distance"),
        F.round(1 - F.col("distance"), 6).alias("relevance"),
        # Files and imports have no name of their own: tell them apart by their text.
        F.coalesce(
            F.nullif(F.col("name"), blank), F.col("import_statement"), F.col("file_path"), blank
        ).alias("dedup_name"),
    ]


def sparse_result() -> Column:
    """Result struct with empty fields nulled, so JSON output leaves them out."""

    def filled(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return F.struct(
        filled("file_path").alias("file"),
        filled("name").alias("name"),
        filled("kind").alias("kind"),
        filled("signature").alias("signature"),
        F.when(F.col("start_line") != 0, F.array("start_line", "end_line")).alias("lines"),
        filled("docstring").alias("docstring"),
        F.when(F.col("relevance") != 0, F.round("relevance", RELEVANCE_DIGITS)).alias("relevance"),
    )


def sparse_json() -> Column:
    return F.to_json(sparse_result(), {"ignoreNullFields": "true"})


def envelope(results: DataFrame) -> DataFrame:
    """``{results, total, query}`` per question. Result lists are cut to top-k before."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", sparse_json().alias("json"))))
    return results.groupBy("query_id", "query_text").agg(
        F.transform(ordered, lambda r: r["json"]).alias("results"),
        F.count(F.lit(1)).alias("total"),
    )


def response(results: DataFrame, query: str, stale: dict | None = None) -> DataFrame:
    """One row: results in sparse JSON by rank, total, query, and a warning where files have changed.

    ``results`` is one question's, cut before; rows without the columns of a search
    result are given as they are.
    """
    searched = {"rank", "file_path", "name", "kind", "signature", "start_line", "end_line", "docstring", "relevance"}
    row = sparse_json() if searched <= set(results.columns) else F.to_json(F.struct("*"), {"ignoreNullFields": "true"})
    rank = F.col("rank").cast("bigint") if "rank" in results.columns else F.lit(0).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct(rank.alias("rank"), row.alias("json"))))
    warning, changed = (stale or {}).get("stale_warning"), (stale or {}).get("changed_files", [])
    return results.agg(
        F.transform(listed, lambda r: r["json"]).alias("results"),
        F.count(F.lit(1)).alias("total"),
    ).withColumns({
        "query": F.lit(query),
        "stale_warning": F.lit(warning).cast("string"),
        "changed_files": F.array(*map(F.lit, changed)).cast("array<string>"),
    })


def response_length() -> Column:
    """Characters of a response as compact JSON; the warning counts where there is one."""
    warning = F.when(F.col("stale_warning").isNotNull(), F.struct("stale_warning", "changed_files"))
    frame = F.to_json(F.struct(F.lit("").alias("results"), "total", "query", warning.alias("_stale")), {"ignoreNullFields": "true"})
    # The frame's two quotes give way to brackets; rows are joined by commas.
    inside = F.aggregate("results", F.lit(0), lambda n, r: n + F.length(r)) + F.greatest(F.size("results") - 1, F.lit(0))
    return (F.length(frame) + inside).cast("bigint")


def index_report(counters: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Index outcome per repository, with at most ``ERROR_LIMIT`` error lines."""
    report = counters.withColumn("status", F.lit("completed"))
    if errors is None:
        return report.withColumn("errors", F.array().cast("array<string>"))
    from loomgraph.operators.topk import top_k

    kept = top_k(errors, ["repo_id"], [F.col("file_path"), F.col("message")], ERROR_LIMIT, "file_path")
    listed = kept.groupBy("repo_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("file_path", "message"))), lambda e: e["message"]
        ).alias("errors")
    )
    return report.join(listed, "repo_id", "left").withColumn(
        "errors", F.coalesce("errors", F.array().cast("array<string>"))
    )


def flatten_properties(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """JSON object of ``column`` as typed columns; unreadable JSON gives nulls."""
    ddl = ", ".join(f"{name} {kind}" for name, kind in fields.items())
    parsed = F.from_json(column, ddl, {"mode": "PERMISSIVE"})
    return df.withColumn("_p", parsed).select(
        *[c for c in df.columns if c != column], *[F.col(f"_p.{n}").alias(n) for n in fields]
    )
