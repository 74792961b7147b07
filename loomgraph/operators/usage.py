"""Token accounting of tool calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Characters per token, and (grep calls, characters per grep,
# file reads, characters per read) a tool call is assumed to replace.
CHARS_PER_TOKEN = 4
REPLACED_WORK = {
    "search_code": (4, 1200, 3, 3000),
    "find_symbol": (2, 800, 2, 4000),
    "get_dependencies": (3, 600, 4, 3000),
    "get_dependents": (5, 1500, 3, 3000),
    "get_file_summary": (0, 0, 1, 8000),
}
RESULTS_PER_UNIT = 5


def response_tokens(length: Column) -> Column:
    """Tokens of a response of ``length`` characters, at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.floor(length / CHARS_PER_TOKEN).cast("bigint"))


def replaced_tokens(tool: Column, results: Column) -> Column:
    """Tokens the call would have cost by grep and file reads; 0 for other tools."""
    base = F.lit(0)
    for name, (greps, grep_chars, reads, read_chars) in REPLACED_WORK.items():
        tokens = greps * grep_chars // CHARS_PER_TOKEN + reads * read_chars // CHARS_PER_TOKEN
        base = F.when(tool == name, F.lit(tokens)).otherwise(base)
    scale = F.greatest(F.lit(1.0), results / F.lit(float(RESULTS_PER_UNIT)))
    return F.floor(base * scale).cast("bigint")


def measured(calls: DataFrame) -> DataFrame:
    """``calls`` (tool, ts, response_len, result_count) with their token columns."""
    used = response_tokens(F.col("response_len"))
    replaced = replaced_tokens(F.col("tool"), F.col("result_count"))
    return calls.select(
        F.to_date("ts").alias("day"),
        "tool",
        used.alias("tokens"),
        replaced.alias("traditional"),
        F.greatest(F.lit(0).cast("bigint"), replaced - used).alias("saved"),
    )


def _totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("calls"),
        F.sum("tokens").alias("tokens"),
        F.sum("traditional").alias("traditional"),
        F.sum("saved").alias("saved"),
    ]


def saved_percent(saved: Column, traditional: Column) -> Column:
    return F.when(traditional > 0, F.round(saved / traditional * 100, 1)).otherwise(F.lit(0.0))


def by_tool(calls: DataFrame) -> DataFrame:
    return measured(calls).groupBy("day", "tool").agg(*_totals())


def daily(calls: DataFrame) -> DataFrame:
    totals = measured(calls).groupBy("day").agg(*_totals())
    return totals.withColumn("saved_pct", saved_percent(F.col("saved"), F.col("traditional")))


def lifetime(calls: DataFrame) -> DataFrame:
    return measured(calls).agg(*_totals())


def cube(calls: DataFrame) -> DataFrame:
    """Per (day, tool), per day and lifetime totals out of one aggregation."""
    sets = [[F.col("day"), F.col("tool")], [F.col("day")], []]
    return (
        measured(calls)
        .groupingSets(sets, F.col("day"), F.col("tool"))
        .agg(*_totals(), F.grouping_id().cast("bigint").alias("level"))
    )


def today(calls: DataFrame, day: Column) -> DataFrame:
    """Totals per tool of one day with the day's own totals and percentage."""
    rows = measured(calls).filter(F.col("day") == day)
    return (
        rows.rollup("day", "tool")
        .agg(*_totals(), F.grouping_id().alias("_g"))
        .filter("_g < 3")
        .drop("_g")
        .withColumn("saved_pct", saved_percent(F.col("saved"), F.col("traditional")))
    )


def last_days(calls: DataFrame, days: int = 7) -> DataFrame:
    """The last ``days`` days that have calls, newest first, after the daily roll-up."""
    per_day = daily(calls)
    return per_day.orderBy(F.col("day").desc()).limit(days)


def summary(calls: DataFrame, days: int = 7) -> DataFrame:
    """One row over the last recorded days plus lifetime numbers.

    Only the daily roll-up is ranked, which has one row per calendar day.
    """
    per_day = daily(calls)
    ranked = per_day.withColumn("_n", F.row_number().over(Window.orderBy(F.col("day").desc())))
    recent = F.col("_n") <= days
    total = lambda c: F.coalesce(F.sum(F.when(recent, F.col(c))), F.lit(0)).cast("bigint")
    return ranked.agg(
        F.count_if(recent).alias("days"),
        total("calls").alias("total_calls"),
        total("tokens").alias("total_tokens"),
        total("traditional").alias("total_traditional"),
        total("saved").alias("total_saved"),
        F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint").alias("lifetime_calls"),
        F.coalesce(F.sum("saved"), F.lit(0)).cast("bigint").alias("lifetime_saved"),
    ).withColumn(
        "overall_pct", saved_percent(F.col("total_saved"), F.col("total_traditional"))
    )
