"""Benchmark items contained in long documents: MinHash containment search, exact check.

An item's signature holds, for each of ``hashes`` hash functions, its shingle of smallest
hash: an unbiased sample, so a document that contains a share c of the item contains each
of these shingles with probability c, however long it is. The signature is cut into bands;
a document that holds all shingles of a band is a candidate. Documents are partitioned by
size, and larger ones, where chance finds grow, need longer bands. Candidates are then
held against the exact shingles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import broadcastable, saved, words


@dataclass(frozen=True)
class LeakSettings:
    """Rows per band by document size in shingles; an item at the threshold is missed by
    all bands with probability below (1 - 0.75^3)^32 = 3e-8."""

    width: int = 5
    threshold_pct: int = 75
    hashes: int = 96
    partitions: tuple[tuple[int, int], ...] = ((1 << 10, 1), (1 << 14, 2), (1 << 62, 3))
    broadcast_probes: int = 500_000
    broadcast_pairs: int = 200_000


PRODUCTION = LeakSettings()


def _shingles(tokens: str, width: Column | int, hashed: bool) -> Column:
    """Runs of ``width`` words of an array column, as text or (fixed width) as hashes."""
    w = F.lit(width) if isinstance(width, int) else width
    starts = F.sequence(F.lit(1), F.size(tokens) - w + 1)
    if hashed:
        made = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(tokens, (i + k).cast("int")) for k in range(width))))
        empty = "array<bigint>"
    else:
        made = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, w), " "))
        empty = "array<string>"
    return F.when(F.size(tokens) >= w, made).otherwise(F.array().cast(empty))


def _tokens(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, words(F.lower("text")).alias("tokens"))


def item_shingles(items: DataFrame, settings: LeakSettings = PRODUCTION) -> DataFrame:
    """(item_id, width, exact) of every item that has a word; short items are one shingle."""
    named = _tokens(items, "item_id").where(F.size("tokens") > 0)
    named = named.withColumn("width", F.least(F.lit(settings.width), F.size("tokens")))
    return named.select("item_id", "width", F.array_distinct(_shingles("tokens", F.col("width"), hashed=False)).alias("exact"))


def _probes(items: DataFrame, settings: LeakSettings) -> DataFrame:
    """(shingle, item_id, picks): the distinct shingles of a signature and the hash functions that picked them."""
    each = _tokens(items, "item_id").where(F.size("tokens") > 0)
    made = F.coalesce(*(F.when(F.least(F.lit(settings.width), F.size("tokens")) == w, _shingles("tokens", w, hashed=True)) for w in range(1, settings.width + 1)))
    each = each.select("item_id", F.explode(made).alias("shingle"))
    best = [F.min(F.struct(F.xxhash64("shingle", F.lit(i)).alias("rank"), "shingle")).alias(f"m{i}") for i in range(settings.hashes)]
    picks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"m{i}.shingle").alias("shingle")) for i in range(settings.hashes))))
    return (
        each.groupBy("item_id").agg(*best).select("item_id", picks.alias("p"))
        .groupBy("item_id", "p.shingle").agg(F.collect_list("p.i").alias("picks"))
    )


def _rows_per_band(size: Column, settings: LeakSettings) -> Column:
    out = F.lit(settings.partitions[-1][1])
    for upto, rows in reversed(settings.partitions[:-1]):
        out = F.when(size <= upto, F.lit(rows)).otherwise(out)
    return out


def candidates(docs: DataFrame, items: DataFrame, settings: LeakSettings = PRODUCTION) -> DataFrame:
    """Distinct (doc_id, item_id) where the document holds a whole band of the item."""
    probes = saved(_probes(items, settings))
    widths = [r.width for r in item_shingles(items, settings).select("width").distinct().collect()]
    if not widths:
        return docs.select("doc_id").limit(0).crossJoin(items.select("item_id").limit(0))
    made = F.concat(*(_shingles("tokens", w, hashed=True) for w in sorted(widths)))
    # The outer form, as the plain one makes the optimizer add a filter on the array's
    # size, below which it repeats the split into words for every shingle.
    found = (
        _tokens(docs, "doc_id").select("doc_id", _rows_per_band(F.size("tokens"), settings).alias("rows"), F.explode_outer(made).alias("shingle"))
        .join(broadcastable(probes, settings.broadcast_probes), "shingle")
        .select("doc_id", "item_id", "rows", F.explode("picks").alias("pick"))
    )
    bands = found.groupBy("doc_id", "item_id", "rows", F.floor(F.col("pick") / F.col("rows")).alias("band")).agg(F.countDistinct("pick").alias("n"))
    return bands.where("n = rows").select("doc_id", "item_id").distinct()


def leaks(docs: DataFrame, items: DataFrame, settings: LeakSettings = PRODUCTION) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared) for every item of which a document
    holds at least the threshold of the distinct shingles; ``docs`` rows that repeat
    give repeated rows.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are
    ignored. Null and wordless texts contain nothing and are contained in nothing; items
    below the shingle width are one shingle of all their words. Null ids are reported as
    null. Items of one id are one item each: pass distinct ids. Empty tables give no rows.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    pairs = saved(candidates(docs, items, settings))
    named = item_shingles(items, settings)
    pairs = broadcastable(pairs, settings.broadcast_pairs).toDF("pair_doc", "pair_item")
    joined = docs.join(pairs, docs["doc_id"].eqNullSafe(pairs["pair_doc"]))
    joined = joined.join(named, joined["pair_item"].eqNullSafe(named["item_id"]))
    # Written, so that the optimizer can't repeat the split into words for every shingle.
    joined = saved(joined.select("doc_id", "item_id", "width", "exact", words(F.lower("text")).alias("tokens")))
    shared = F.size(F.array_intersect("exact", _shingles("tokens", F.col("width"), hashed=False)))
    return (
        joined.select("doc_id", "item_id", F.size("exact").alias("n_item_shingles"), shared.alias("n_shared"))
        .where(100 * F.col("n_shared") >= settings.threshold_pct * F.col("n_item_shingles"))
    )
