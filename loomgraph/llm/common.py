"""Reading documents, keeping intermediate tables, words as columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomgraph.session import shared_folder
from loomgraph.sources.tables import table

#: A word: anything between the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


#: Rows handed to Python at once where texts travel; bounds the Arrow buffers on both sides.
ARROW_ROWS = 1000


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder all executors share, and read back.

    Cuts the lineage on reliable storage and keeps column pruning for the readers.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(place)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(place)


def words(text: Column) -> Column:
    """All words of a text as an array; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def broadcastable(df: DataFrame, limit: int) -> DataFrame:
    """``df`` (saved, narrow), to be broadcast only if its counted rows stay within ``limit``."""
    return F.broadcast(df) if df.count() <= limit else df
