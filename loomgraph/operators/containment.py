"""Enclosing-interval lookup for nested (never partly overlapping) line ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def with_enclosing(
    rows: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    is_interval: Column,
    order: Sequence[str],
    payload: Sequence[str],
    result: str,
    outermost: bool = False,
) -> DataFrame:
    """Attach the interval of the same ``keys`` group that encloses each row.

    Interval rows span ``start..end``; other rows are points at ``start``. The
    innermost strictly enclosing interval is attached, or the outermost one on
    request (for a point) as a struct of ``payload``. No pair is ever formed: a
    running count of open intervals gives each row its depth, and in one (group,
    depth) sequence the last interval opened before a row is the one around it.
    Both windows reuse the partitioning of ``keys``.
    """
    opening = F.struct(F.col(start).alias("pos"), F.lit(0).alias("step"), F.lit(1).alias("delta"))
    closing = F.struct(F.col(end).alias("pos"), F.lit(2).alias("step"), F.lit(-1).alias("delta"))
    point = F.struct(F.col(start).alias("pos"), F.lit(1).alias("step"), F.lit(0).alias("delta"))
    marked = rows.withColumn("_span", F.coalesce(is_interval, F.lit(False)))
    events = marked.withColumn(
        "_e", F.explode(F.when(F.col("_span"), F.array(opening, closing)).otherwise(F.array(point)))
    )
    sequence = [F.col("_e.pos"), F.col("_e.step"), F.col(end).desc_nulls_last(), *map(F.col, order)]
    swept = events.withColumn(
        "_depth",
        F.sum("_e.delta").over(
            Window.partitionBy(*keys)
            .orderBy(*sequence)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ),
    ).filter("_e.step < 2")

    candidate = F.struct(*[F.col(c) for c in payload])
    if outermost:
        probe_depth = F.when(F.col("_depth") >= 1, F.lit(1)).otherwise(F.lit(0))
        probe_depth = F.when(F.col("_span"), F.lit(0)).otherwise(probe_depth)
    else:
        probe_depth = F.when(F.col("_span"), F.col("_depth") - 1).otherwise(F.col("_depth"))
    kind = candidate_type(rows, payload)
    as_probe = F.struct(
        probe_depth.cast("bigint").alias("depth"), F.lit(True).alias("probe"),
        F.lit(None).cast(kind).alias("found"),
    )
    as_candidate = F.struct(
        F.col("_depth").cast("bigint").alias("depth"), F.lit(False).alias("probe"),
        candidate.cast(kind).alias("found"),
    )
    levels = swept.withColumn(
        "_l",
        F.explode(
            F.when(F.col("_span"), F.array(as_probe, as_candidate)).otherwise(F.array(as_probe))
        ),
    )
    around = F.last("_l.found", ignorenulls=True).over(
        Window.partitionBy(*keys, "_l.depth")
        .orderBy(*sequence, F.col("_l.probe").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        levels.withColumn(result, F.when(F.col("_l.depth") >= 1, around))
        .filter("_l.probe")
        .drop("_span", "_e", "_depth", "_l")
    )


def candidate_type(rows: DataFrame, payload: Sequence[str]) -> str:
    fields = ",".join(f"{c}:{rows.schema[c].dataType.simpleString()}" for c in payload)
    return f"struct<{fields}>"
