"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification.

Every distinct shingle set (a class of copies) gets a signature of BANDS x ROWS minimum
hashes. Classes that agree on a whole band are candidates. Their signatures are compared
batch by batch: with a uniform prior the similarity of a pair that agreed on m of n hashes
is Beta(m + 1, n - m + 1), and the pair is pruned once P(similarity >= threshold) falls
below the chosen miss probability. Survivors are compared on their full shingle sets.

A band's bucket never yields all its pairs: each member meets the bucket's centre first.
Where a bucket then still holds several components, members of different components may
have links that join them. A shingle that no other class of such buckets has can't be
common to a pair, which rules out classes by a count; the others are compared exactly with
those of other components, inside the join that finds them, so that no link that could join
two components is lost and no pair leaves a task but the links.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.common import broadcastable, saved
from loomgraph.llm.components import components
from loomgraph.llm.hashing import mix, random_numbers, shingle_set, word_hashes


@dataclass(frozen=True)
class NearSettings:
    """A pair at the threshold shares no band with probability (1 - 0.75^5)^48 = 2e-6."""

    width: int = 5
    threshold_pct: int = 75
    bands: int = 48
    rows: int = 5
    batch: int = 24
    miss: float = 1e-6
    broadcast_classes: int = 1_000_000  # two numbers each

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


PRODUCTION = NearSettings()
_BLOCK = 256


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each hash a*x + b (mod 2^32) over a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), _BLOCK):
        y = x[k : k + _BLOCK, None] * a
        y += b
        np.minimum(best, y.min(axis=0), out=best)
    return best


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    high = np.uint64(32)
    return (random_numbers(n, 7) >> high).astype(np.uint32) | np.uint32(1), (random_numbers(n, 8) >> high).astype(np.uint32)


def _band_keys(signatures: np.ndarray, settings: NearSettings) -> np.ndarray:
    """One 64-bit key per row and band; equal keys of different bands differ."""
    rows = signatures.reshape(len(signatures), settings.bands, settings.rows).astype(np.uint64)
    keys = np.broadcast_to(random_numbers(settings.bands, 9), rows.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for k in range(settings.rows):
            keys = mix(keys ^ rows[:, :, k])
    return keys.view(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Equal-length rows of bytes as a binary column without a copy per row."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _set_id(shingles: np.ndarray) -> int:
    """64-bit name of a shingle set."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch], settings: NearSettings) -> Iterator[pa.RecordBatch]:
    a, b = _hash_family(settings.hashes)
    for batch in batches:
        n = batch.num_rows
        counts, ids = np.zeros(n, np.int64), np.zeros(n, np.int64)
        signatures = np.zeros((n, settings.hashes), np.uint32)
        for row, hashes in word_hashes(batch.column("text"), lower=True):
            shingles = shingle_set(hashes, settings.width)
            if len(shingles):
                counts[row] = len(shingles)
                ids[row] = _set_id(shingles)
                signatures[row] = signature(shingles, a, b)
        keys = _band_keys(signatures, settings)
        bands = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * settings.bands, pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts), pa.array(ids, mask=counts == 0), _binary(signatures), bands],
            ["doc_id", "n_shingles", "set_id", "signature", "bands"],
        )


def sketches(docs: DataFrame, settings: NearSettings = PRODUCTION) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature, bands) of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _sketch(batches, settings),
        "doc_id long, n_shingles long, set_id long, signature binary, bands array<long>",
    )


def least_matches(settings: NearSettings) -> list[tuple[int, int]]:
    """(hashes seen, fewest matches to stay) per batch.

    P(J >= t | m of n) = P(Binomial(n + 1, t) <= m) under a uniform prior; the miss
    probability is shared out over the batches.
    """
    t = settings.threshold_pct / 100
    share = settings.miss / (settings.hashes / settings.batch)
    bounds = []
    for n in range(settings.batch, settings.hashes + 1, settings.batch):
        below, m = 0.0, -1
        while below < share:
            m += 1
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        bounds.append((n, m))
    return bounds


def _prune(batches: Iterator[pa.RecordBatch], settings: NearSettings) -> Iterator[pa.RecordBatch]:
    bounds = least_matches(settings)

    def rows(column: pa.Array) -> np.ndarray:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
        begin, end = offsets[column.offset], offsets[column.offset + len(column)]
        return np.frombuffer(column.buffers()[2], np.uint8)[begin:end].view(np.uint32).reshape(len(column), settings.hashes)

    for batch in batches:
        if not batch.num_rows:
            continue
        left, right = rows(batch.column("left")), rows(batch.column("right"))
        alive, matches = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for seen, least in bounds:
            part = slice(seen - settings.batch, seen)
            matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
            stay = matches >= least
            alive, matches = alive[stay], matches[stay]
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], ["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch], settings: NearSettings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known = {}
        for side in ("a", "b"):
            ids = batch.column(side).to_pylist()
            new = {x: i for i, x in enumerate(ids) if x not in known}
            texts = batch.column(f"text_{side}").take(pa.array(list(new.values()), pa.int64()))
            names = list(new)
            for row, hashes in word_hashes(texts, lower=True):
                known[names[row]] = shingle_set(hashes, settings.width)
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(a, b)):
            both = len(np.intersect1d(known[x], known[y], assume_unique=True))
            if 100 * both >= settings.threshold_pct * (len(known[x]) + len(known[y]) - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])


def _shingle_lists(batches: Iterator[pa.RecordBatch], settings: NearSettings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(hashes, settings.width).view(np.int64) for _, hashes in word_hashes(batch.column("text"), lower=True)]
        offsets = np.cumsum([0, *map(len, sets)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("set_id"), lists], ["set_id", "shingles"])


class _Corpus:
    """Where the verification finds the signatures and texts of the classes it is asked for."""

    def __init__(self, docs: DataFrame, made: DataFrame, first: DataFrame, settings: NearSettings):
        self.docs, self.made, self.first, self.settings = docs, made, first, settings

    def _wanted(self, ids: DataFrame) -> DataFrame:
        """(set_id, doc_id) of one document per class; broadcast while that is small."""
        return broadcastable(saved(self.first.join(ids.distinct(), "set_id", "left_semi")), self.settings.broadcast_classes)

    def signatures(self, ids: DataFrame) -> DataFrame:
        rows = self.made.select("set_id", "doc_id", "n_shingles", "signature").join(self._wanted(ids), ["set_id", "doc_id"], "left_semi")
        return saved(rows.drop("doc_id").dropDuplicates(["set_id"]))

    def texts(self, ids: DataFrame) -> DataFrame:
        """One text per class; where a doc_id repeats, the row with the class's text is found by its shingles."""
        settings, wanted = self.settings, self._wanted(ids)
        rows = self.docs.join(wanted, "doc_id").select("set_id", "text")
        return saved(rows.mapInArrow(lambda batches: _own_texts(batches, settings), "set_id long, text string").dropDuplicates(["set_id"]))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes whose full shingle sets pass the threshold."""
        settings, pairs = self.settings, saved(pairs.distinct())
        sized = self.signatures(pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")))
        close = saved(
            pairs.join(sized.select(F.col("set_id").alias("a"), F.col("signature").alias("left"), F.col("n_shingles").alias("n_a")), "a")
            .join(sized.select(F.col("set_id").alias("b"), F.col("signature").alias("right"), F.col("n_shingles").alias("n_b")), "b")
            .where(_reachable(F.least("n_a", "n_b"), settings))
            .select("a", "b", "left", "right")
            .mapInArrow(lambda batches: _prune(batches, settings), "a long, b long")
        )
        texts = self.texts(close.select(F.col("a").alias("set_id")).union(close.select("b")))
        return (
            close.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
            .select("a", "b", "text_a", "text_b")
            .mapInArrow(lambda batches: _exact(batches, settings), "a long, b long")
        )

    def shingles(self, ids: DataFrame) -> DataFrame:
        """(set_id, shingles, n_shared) of the classes: n_shared counts the shingles that at
        least one other class among ``ids`` has too."""
        settings = self.settings
        sets = saved(self.texts(ids.distinct()).mapInArrow(lambda batches: _shingle_lists(batches, settings), "set_id long, shingles array<long>"))
        alone = sets.select("set_id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.max("set_id").alias("set_id")).where("n = 1")
        alone = alone.groupBy("set_id").agg(F.count("*").alias("alone"))
        return sets.join(alone, "set_id", "left").select("set_id", "shingles", (F.size("shingles") - F.coalesce("alone", F.lit(0))).alias("n_shared"))


def _own_texts(batches: Iterator[pa.RecordBatch], settings: NearSettings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("set_id").to_pylist()
        keep = [row for row, hashes in word_hashes(batch.column("text"), lower=True) if len(hashes) and _set_id(shingle_set(hashes, settings.width)) == ids[row]]
        yield batch.take(pa.array(keep, pa.int64()))


def _reachable(shared, settings: NearSettings):
    """Whether n_a and n_b shingles with at most ``shared`` in common can pass."""
    return 100 * shared >= settings.threshold_pct * (F.col("n_a") + F.col("n_b") - shared)


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component's root of each set_id, itself where nothing links it."""
    return rows.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def _open_buckets(rows: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one component."""
    several = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rows.join(several, "key", "left_semi")


def near_duplicates(docs: DataFrame, settings: NearSettings = PRODUCTION) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``docs`` needs doc_id and text; other columns are ignored. A null or wordless text
    has no shingles and is linked with nothing. Equal shingle sets are one class, whose
    members are linked without being compared. A null doc_id takes part in no group:
    its component_id is null and it is kept. Rows that repeat a doc_id stay rows of their
    own. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    made = saved(sketches(docs, settings))
    ids = made.select("doc_id", "n_shingles", "set_id")
    named = made.where("set_id is not null and doc_id is not null")
    first = saved(named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")))
    corpus = _Corpus(docs, made, first, settings)

    keys = named.select("set_id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high").select("key")
    members = saved(keys.join(shared, "key").distinct())

    # The centre of a bucket is the member that meets most others over all its buckets:
    # in a group of near copies, the text that the others were made from.
    counted = members.join(members.groupBy("key").agg(F.count("*").alias("n")), "key")
    meets = counted.groupBy("set_id").agg(F.sum("n").alias("meets"))
    ranked = saved(members.join(meets, "set_id"))
    centre = F.max(F.struct("meets", "set_id")).alias("top")
    told = saved(ranked.join(ranked.groupBy("key").agg(centre).select("key", F.col("top.set_id").alias("centre")), "key").where("set_id != centre").drop("meets"))
    links = saved(corpus.verified(told.select(F.col("centre").alias("a"), F.col("set_id").alias("b"))))
    roots = components(links.toDF("u", "v"))

    # Buckets whose other members still span several components: these meet across
    # components. A pair needs its common shingles among those that another open class has.
    told = saved(_labelled(told.select("key", "set_id"), roots))
    rest = saved(_open_buckets(told))
    sets = saved(corpus.shingles(rest.select("set_id")))
    rest = rest.join(sets.select("set_id", "n_shared", F.size("shingles").alias("n")), "set_id")
    rest = saved(rest)
    least = rest.groupBy("key").agg(F.min("n").alias("least"))
    n, shared_n = F.col("n"), F.col("n_shared")
    possible = 100 * shared_n >= settings.threshold_pct * (n + F.greatest("least", shared_n) - shared_n)
    rest = _open_buckets(rest.join(least, "key").where(possible).drop("least"))
    rest = saved(rest.join(sets.drop("n_shared"), "set_id").select("key", "set_id", "root", "n", "n_shared", "shingles"))
    # The exact comparison is part of the join's condition, so only links leave it.
    t = settings.threshold_pct
    left = rest.toDF("key_a", "a", "root_a", "n_a", "shared_a", "set_a")
    right = rest.toDF("key_b", "b", "root_b", "n_b", "shared_b", "set_b")
    linked = (
        (F.col("key_a") == F.col("key_b")) & (F.col("root_a") < F.col("root_b"))
        & _reachable(F.least("shared_a", "shared_b", "n_a", "n_b"), settings)
        & ((100 + t) * F.size(F.array_intersect("set_a", "set_b")) >= t * (F.col("n_a") + F.col("n_b")))
    )
    across = saved(left.join(right, linked).select("a", "b").distinct())
    # The components so far are stars; the new links join them.
    roots = components(roots.toDF("u", "v").unionByName(across.toDF("u", "v")))

    class_root = _labelled(first, roots)
    smallest = class_root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = class_root.join(smallest, "root").select("set_id", "component_id")
    return ids.join(by_class, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(
            F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
        ).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")), F.lit(True)).alias("kept"),
    )
