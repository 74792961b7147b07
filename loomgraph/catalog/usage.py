"""Token accounting and change bursts over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog.registry import query
from loomgraph.operators import usage
from loomgraph.operators.bursts import bursts
from loomgraph.session import scratch_folder
from loomgraph.sources.tables import table, tool_calls
from loomgraph.streaming.watch import closed_bursts

CALLS_SQL = """
    calls as (
        select case event_type when 'click' then 'search_code' when 'view' then 'find_symbol'
                   when 'purchase' then 'get_dependencies' when 'signup' then 'get_file_summary'
                   else 'advise' end as tool,
               ts::date as day, greatest(1, length(props) // 4) as tokens,
               (props->>'$.k')::bigint as results from events),
    priced as (
        select *, floor(case tool when 'search_code' then 3450 when 'find_symbol' then 2400
                   when 'get_dependencies' then 3450 when 'get_dependents' then 4125
                   when 'get_file_summary' then 2000 else 0 end
                   * greatest(1.0::double, results::double / 5))::bigint as traditional from calls),
    measured as (select *, greatest(0, traditional - tokens) as saved from priced)"""

TOTALS_SQL = """count(*)::bigint as calls, sum(tokens)::bigint as tokens,
    sum(traditional)::bigint as traditional, sum(saved)::bigint as saved"""

PCT_SQL = "case when {t} > 0 then round({s} / {t} * 100, 1) else 0.0::double end::double"


@query("usage_by_tool", f"with {CALLS_SQL} select day, tool, {TOTALS_SQL} from measured group by all")
def usage_by_tool(spark, folder):
    return usage.by_tool(tool_calls(spark, folder))


DAILY_SQL = f"""daily as (select *, {PCT_SQL.format(s='saved', t='traditional')} as saved_pct
    from (select day, {TOTALS_SQL} from measured group by day))"""


@query("usage_daily", f"with {CALLS_SQL}, {DAILY_SQL} select * from daily")
def usage_daily(spark, folder):
    return usage.daily(tool_calls(spark, folder))


@query("usage_lifetime", f"with {CALLS_SQL} select {TOTALS_SQL} from measured")
def usage_lifetime(spark, folder):
    return usage.lifetime(tool_calls(spark, folder))


@query(
    "usage_grouping_sets",
    f"""with {CALLS_SQL} select day, tool, {TOTALS_SQL}, grouping_id(day, tool)::bigint as level
        from measured group by grouping sets ((day, tool), (day), ())""",
)
def usage_grouping_sets(spark, folder):
    return usage.cube(tool_calls(spark, folder))


@query(
    "usage_last_n_days",
    f"with {CALLS_SQL}, {DAILY_SQL} select * from daily order by day desc limit 7",
)
def usage_last_n_days(spark, folder):
    return usage.last_days(tool_calls(spark, folder), 7)


@query(
    "usage_summary",
    f"""with {CALLS_SQL}, {DAILY_SQL},
        recent as (select * from daily order by day desc limit 7)
        select count(*)::bigint as days, sum(calls)::bigint as total_calls,
            sum(tokens)::bigint as total_tokens, sum(traditional)::bigint as total_traditional,
            sum(saved)::bigint as total_saved,
            (select sum(calls)::bigint from daily) as lifetime_calls,
            (select sum(saved)::bigint from daily) as lifetime_saved,
            {PCT_SQL.format(s='sum(saved)', t='sum(traditional)')} as overall_pct
        from recent""",
)
def usage_summary(spark, folder):
    return usage.summary(tool_calls(spark, folder), 7)


@query(
    "usage_today",
    f"""with {CALLS_SQL},
        last_day as (select * from measured where day = (select max(day) from measured)),
        t as (select day, tool, {TOTALS_SQL} from last_day group by grouping sets ((day, tool), (day)))
        select *, {PCT_SQL.format(s='saved', t='traditional')} as saved_pct from t""",
)
def usage_today(spark, folder):
    """The report of one day; the newest day of the log stands for today."""
    calls = tool_calls(spark, folder)
    newest = calls.agg(F.max(F.to_date("ts"))).first()[0]
    return usage.today(calls, F.lit(newest))


@query(
    "response_tokens",
    """
    select conv_id, turn,
        greatest(1, length(to_json({role: role, text: text})::varchar) // 4)::bigint as tokens
    from conversations
    """,
)
def response_tokens(spark, folder):
    """Token estimate of every conversation turn as compact JSON."""
    turns = table(spark, folder, "conversations")
    length = F.length(F.to_json(F.struct("role", "text"))).cast("bigint")
    return turns.select("conv_id", "turn", usage.response_tokens(length).alias("tokens"))


def bursts_sql(key: str, gap: str) -> str:
    return f"""
    with marked as (
        select {key} as key, ts, case when ts - lag(ts) over w <= interval {gap} then 0 else 1 end as opens
        from events window w as (partition by {key} order by ts, event_id)),
    runs as (select *, sum(opens) over (partition by key order by ts rows unbounded preceding) as burst from marked)
    select key, burst::bigint as burst, min(ts) as first_ts, max(ts) as last_ts, count(*)::bigint as changes
    from runs group by key, burst"""


def _bursts(spark, folder, key, gap):
    events = table(spark, folder, "events").select(key.alias("key"), "ts")
    found = bursts(events, "key", "ts", gap)
    return found.select(
        "key", "burst", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
        F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "changes",
    )


@query("debounce_sessions", bursts_sql("'repo'", "2 seconds"))
def debounce_sessions(spark, folder):
    """The whole log as changes of one repository, debounced at two seconds."""
    return _bursts(spark, folder, F.lit("repo"), 2)


@query("debounce_sessions_by_user", bursts_sql("user_id", "1 hour"))
def debounce_sessions_by_user(spark, folder):
    return _bursts(spark, folder, F.col("user_id"), 3600)


@query(
    "stream_debounce",
    bursts_sql("user_id", "1 hour").replace("select key, burst::bigint as burst,", "select key as repo_id,")
    + " having max(ts) + interval 1 hour <= (select max(ts) from events)",
)
def stream_debounce(spark, folder):
    """The event log as a change stream: the bursts closed by the end of the log.

    Runs the stream to its end and reads back what it appended.
    """
    schema = table(spark, folder, "events").schema
    # The pattern finds the table as one file and as a folder of files.
    stream = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    changes = stream.select(F.col("user_id").alias("repo_id"), "ts")
    out = scratch_folder(spark)
    closed = closed_bursts(changes, 3600)
    running = (
        closed.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/bursts")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    found = spark.read.schema(closed.schema).parquet(f"{out}/bursts")
    return found.select(
        "repo_id", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"),
        F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "changes",
    )
