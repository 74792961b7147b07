"""Debounced bursts of change events, for stored streams of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def bursts(
    events: DataFrame, key: str, ts: str, gap_seconds: int = 2, chunk_seconds: int = 86_400
) -> DataFrame:
    """Runs of events of a key in which neighbours are at most ``gap_seconds`` apart.

    Events of one gap-sized bucket always share a burst, so they are combined
    before the exchange. Buckets are then linked inside (key, day) chunks, and a
    summary with one row per chunk carries the state across chunk borders. A key
    with a third of all events is thus spread over its days.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    # A gap longer than a chunk makes chunks of one bucket.
    per_chunk = max(1, chunk_seconds // gap_seconds)
    buckets = (
        events.select(F.col(key), micros.alias("_t"))
        .withColumn("_bucket", F.floor(F.col("_t") / gap))
        .groupBy(key, "_bucket")
        .agg(
            F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count(F.lit(1)).alias("_n")
        )
        .withColumn("_chunk", F.floor(F.col("_bucket") / per_chunk))
    )
    within = Window.partitionBy(key, "_chunk").orderBy("_bucket")
    opens = F.when(F.col("_from") - F.lag("_to").over(within) > gap, 1).otherwise(0)
    marked = buckets.withColumn("_opens", opens)
    runs = marked.withColumn("_run", F.sum("_opens").over(within))
    # Runs inside a chunk; only a chunk's first run can continue the previous chunk.
    local = runs.groupBy(key, "_chunk", "_run").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n")
    )
    edges = local.groupBy(key, "_chunk").agg(
        F.min("_from").alias("_lo"), F.max("_to").alias("_hi"), F.max("_run").alias("_last")
    )
    across = Window.partitionBy(key).orderBy("_chunk")
    breaks = F.coalesce(F.col("_lo") - F.lag("_hi").over(across) > gap, F.lit(True)).cast("int")
    shift = (
        F.sum(breaks + F.col("_last")).over(across) - F.col("_last")
    )
    offsets = edges.select(key, "_chunk", shift.alias("_shift"))
    return (
        local.join(offsets, [key, "_chunk"])
        .groupBy(key, (F.col("_run") + F.col("_shift")).alias("burst"))
        .agg(
            F.min("_from").alias("_from"),
            F.max("_to").alias("_to"),
            F.sum("_n").cast("bigint").alias("changes"),
        )
        .select(
            key,
            F.col("burst").cast("bigint").alias("burst"),
            F.timestamp_micros("_from").alias("first_ts"),
            F.timestamp_micros("_to").alias("last_ts"),
            "changes",
        )
    )
