"""Shards by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone: a linear congruential
generator seeded with the key says at which shard counts the key jumps, and the last jump
below the count is its shard. Appending a shard moves keys into it only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import saved

_TWO64 = "18446744073709551616"
_STEP = "2862933555777941757"

#: Buckets that number rows within a shard; more than a task can't be asked to sort.
SLOT_BUCKETS = 1024


def stable_key(column: Column) -> Column:
    """Unsigned 64-bit number of a value: the first half of its MD5; null is a value of its own."""
    text = F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 16), 16, 10).cast("decimal(38,0)")


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of an unsigned 64-bit key.

    The state is (shard, next jump, key). Every jump goes at least one shard further, so
    ``shards`` rounds are enough; a round after the last jump changes nothing. Products
    modulo 2^64 are made of two halves, each below 10^38. Whole quotients and remainders
    only: division of decimals would round before it is floored.
    """
    two32 = F.lit(2**32).cast("decimal(38,0)")

    def number(expression: Column) -> Column:
        return expression.cast("decimal(38,0)")

    def whole_quotient(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def next_key(k: Column) -> Column:
        step, whole = number(F.lit(_STEP)), number(F.lit(_TWO64))
        high, low = number(whole_quotient(k, two32)), number(k % two32)
        top = number(number(number(high * step) % two32) * two32)
        return number((number(low * step) + top + number(F.lit(1))) % whole)

    def jump(state: Column, _) -> Column:
        k = next_key(state["key"])
        draw = whole_quotient(k, number(F.lit(2**33))).cast("double") + 1
        ahead = F.floor((state["next"] + 1).cast("double") * (F.lit(float(2**31)) / draw)).cast("long")
        live = state["next"] < shards
        return F.struct(
            F.when(live, state["next"]).otherwise(state["shard"]).alias("shard"),
            F.when(live, ahead).otherwise(state["next"]).alias("next"),
            F.when(live, k).otherwise(state["key"]).alias("key"),
        )

    start = F.struct(F.lit(-1).cast("long").alias("shard"), F.lit(0).cast("long").alias("next"), number(key).alias("key"))
    rounds = F.sequence(F.lit(1), F.lit(shards))
    return F.aggregate(rounds, start, jump, lambda state: state["shard"].cast("int"))


def sharded(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """``docs`` with the columns shard and grown_shard (with one shard more)."""
    if shards < 1:
        raise ValueError("at least one shard")
    number = stable_key(F.col(key))
    return docs.withColumns({"shard": jump_shard(number, shards), "grown_shard": jump_shard(number, shards + 1)})


def shard_slots(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Slots number the rows of a shard from 0 without gaps. A shard's rows are sorted in
    SLOT_BUCKETS buckets, each starting where the ones before it end, so no task sorts a
    whole shard; only the narrow columns move. A null text has size 1 and the checksum of
    an empty one. A null doc_id is a key like any other. Repeated rows get slots of their
    own. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    rows = saved(sharded(rows, shards).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS))))
    # shards x SLOT_BUCKETS rows at most.
    start = F.expr("sum(n) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding)")
    begins = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(start, F.lit(0)).alias("begin"))
    within = F.expr("row_number() over (partition by shard, bucket order by doc_id, text_crc32, size)") - 1
    return (
        rows.withColumn("within", within).join(F.broadcast(begins), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                (F.col("begin") + F.col("within")).alias("slot"), "grown_shard")
    )
