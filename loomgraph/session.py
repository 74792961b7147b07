"""Session construction and the few runtime knobs the plans read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Rows of an Arrow batch: whole texts and vectors, so that a batch stays small in a Python worker.
ARROW_ROWS = "1000"


def build_session(
    app_name: str = "loomgraph",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """Return a session with the settings every plan here is written for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset and pass
    them through spark-submit; only UTC, Arrow and adaptive execution are fixed.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Split a hot join key even where that costs one more exchange.
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session without one gets a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        shared = spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def scratch_folder(spark: SparkSession) -> str:
    """A new sub-folder name in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder.

    A checkpoint lies on reliable storage, so losing executors later costs nothing.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back, with column pruning for its readers."""
    place = scratch_folder(df.sparkSession)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def work_partitions(spark: SparkSession) -> int:
    """Partition count for work whose cost is far above its size in bytes.

    That is ``spark.sql.shuffle.partitions``, fixed so that adaptive execution does
    not coalesce it; on one machine no more than four per core.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    context = spark.sparkContext
    if context.master.startswith("local"):
        partitions = min(partitions, 4 * context.defaultParallelism)
    return partitions


def partitions_for(df: DataFrame, rows_each: int = 200_000) -> int:
    """Partition count that keeps the rows of a task the same however large ``df`` is."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_each))


def top_k_salts(spark: SparkSession) -> int:
    """How many slices a top-k group is split into before its final merge.

    A map task never sends more than k rows of a group, so one reducer copes
    until the number of map tasks is large. One slice per 200 shuffle
    partitions keeps small jobs at a single exchange.
    """
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 200)
