"""Top-k per group and keep-best deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.session import top_k_salts


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_on: str | None = None,
    rank: str | None = None,
) -> DataFrame:
    """Keep the first ``k`` rows of every group in a total order.

    Spark cuts each map task to k rows per group before the exchange. With many
    map tasks that still funnels tasks x k rows of a hot group into one reducer,
    so on wide jobs the group is first cut in slices hashed on ``spread_on``.
    """
    position = "_position"
    salts = top_k_salts(df.sparkSession)
    if spread_on is not None and salts > 1:
        slices = df.withColumn("_slice", F.pmod(F.xxhash64(spread_on), F.lit(salts)))
        within = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            slices.withColumn(position, F.row_number().over(within))
            .filter(F.col(position) <= k)
            .drop(position, "_slice")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= k)
    return cut.withColumnRenamed(position, rank) if rank else cut.drop(position)


def keep_best(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``order``. Combined map-side, so hot keys are cheap."""
    names = df.columns
    packed = df.select(
        *[(k if isinstance(k, Column) else F.col(k)).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.struct(*[F.col(n) for n in names]).alias("_row"),
        F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)]).alias("_order"),
    )
    best = packed.groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(
        F.min_by("_row", "_order").alias("_row")
    )
    return best.select("_row.*")
