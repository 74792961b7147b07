"""A corpus from raw documents: filter, deduplicate, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns documents; its result is written and
read again as the next stage's input. A stage that drops documents decides on each row by
itself, under a key that is written with the rows when it starts: rows without an id and
rows that share one are judged like all others.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loomgraph.llm.common import broadcastable, documents, saved
from loomgraph.llm.contamination import leaks
from loomgraph.llm.mixing import mixed
from loomgraph.llm.near import near_duplicates
from loomgraph.llm.risk import quality_verdicts
from loomgraph.llm.sharding import sharded
from loomgraph.sources.tables import table

#: Files of one input whose names are broadcast; more are joined.
MAX_FILES = 100_000

#: Keys, of 8 bytes or a few times that, that are broadcast; more are joined.
MAX_KEYS = 1_000_000


def _rows(docs: DataFrame) -> DataFrame:
    """(row, doc): every row under a key of its own that is the same whenever it is read.

    Rows read from Parquet files have one already: their file and their number in it. Other
    rows are written once under a number.
    """
    doc = F.struct(*docs.columns).alias("doc")
    try:
        placed = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"), doc)
    except AnalysisException:  # not a scan of such files
        return saved(docs.select(F.monotonically_increasing_id().alias("row"), doc))
    number = (F.row_number().over(Window.orderBy("file")) - 1).cast("long")
    # One row per file; files hold less than 2^40 rows.
    files = saved(placed.select("file").distinct().withColumn("number", number))
    return placed.join(broadcastable(files, MAX_FILES), "file").select((F.shiftleft("number", 40) + F.col("at")).alias("row"), "doc")


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows for an operator, with the key in place of their id."""
    return rows.select(F.col("row").alias("doc_id"), *(f"doc.{c}" for c in columns))


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents but for the dropped keys (row), which alone travel while they are few."""
    return rows.join(broadcastable(saved(dropped.distinct()), MAX_KEYS), "row", "left_anti").select("doc.*")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or a certified cutoff."""
    rows = _rows(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("id"), "quality")
    marked = rows.select("row", F.col("doc.doc_id").cast("long").alias("id")).join(labels, "id")
    verdicts = quality_verdicts(_keyed(rows, "text", "lang"), marked.select(F.col("row").alias("doc_id"), "quality"))
    return _without(rows, verdicts.where("not kept").select(F.col("doc_id").alias("row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: of the smallest doc_id (nulls last), then text hash."""
    rows = _rows(docs)
    groups = near_duplicates(_keyed(rows, "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("text_hash"), F.col("row").alias("row"))
    named = rows.select("row", F.col("doc.doc_id").cast("long").alias("id"), F.xxhash64("doc.text").alias("text_hash"))
    members = saved(groups.join(named, "row").select("component_id", order.alias("member")))
    first = members.groupBy("component_id").agg(F.min("member").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = members.join(broadcastable(saved(first.select("component_id", "first")), MAX_KEYS), "component_id").where("member.row != first.row")
    return _without(rows, copies.select("member.row"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows = _rows(docs)
    return _without(rows, leaks(_keyed(rows, "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; own columns of any name come back as they are."""
    taken = mixed(docs.select(F.struct(*docs.columns).alias("doc"), "doc_id", "text", "source")).where("copies > 0")
    return taken.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, which replaces a column of that name."""
    placed = sharded(docs.select(F.struct(*(c for c in docs.columns if c != "shard")).alias("doc"), "doc_id"))
    return placed.select("doc.*", "shard")


STAGES = [
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: No SQL: certified cutoffs, similarity components and tilted rates; tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents table, with the column shard."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
