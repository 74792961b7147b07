"""Collocations by partitioning (SON): mine shards completely, unite, count exactly.

A phrase that occurs ``support`` times in a language occurs, in at least one shard with the
share w of the language's words, support * w times or more. So every shard, a bounded run of
documents, is mined completely at ceil(support * w): level by level, a run of k words is
looked at only if its first and its last k - 1 words are frequent in the shard. A task's
documents of a language are one shard up to a bound: what it keeps of the texts is a hash per
word, and runs are counted a class of their hashes at a time. The union of
what shards find holds every phrase frequent in the whole. A shard that doesn't report a phrase
holds it less often than its support, so the reports also bound each phrase's count from
above, and phrases whose bound is too small leave the union. A last pass counts each of its
members in all tasks, longer ones only where both their shorter parts are members too.

Words and pairs are mined and united first; longer runs are then mined only over pairs of that
union, so that they stay few where shards are many and the local support comes down to 1
(from ``support`` shards of a language on, 1.2 billion words as set below).

Words are named by 64-bit hashes, phrases by a hash of theirs. What is shipped to all tasks
is the union's hashes up to a bound, beyond it a Bloom filter of fixed size, whose false hits
the join with the union drops.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.common import saved
from loomgraph.llm.hashing import buffers, byte_hashes, mix, windows_at

#: Bytes that end a piece; blanks and tabs end words besides.
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?\n\x0b\x0c\r"]] = True
_ENDS_WORD = _ENDS_PIECE.copy()
_ENDS_WORD[[9, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class PhraseSettings:
    support: int = 100
    longest: int = 5
    top: int = 2000
    shard_words: int = 16_000_000  # held by a task; tasks get three quarters of it
    block_words: int = 2_000_000  # of which the texts are held for the last count
    shipped: int = 1_000_000  # hashes, 8 bytes each, that go to all tasks
    filter_bits: int = 27  # the filter beyond that has 2 to this power


PRODUCTION = PhraseSettings()


@dataclass
class Shard:
    """Words of some documents of one language, in order."""

    word: np.ndarray  # hash of each word
    joined: np.ndarray  # whether the next word is of the same piece


@dataclass
class Block(Shard):
    """A shard with its text."""

    data: np.ndarray  # lowered bytes
    start: np.ndarray
    end: np.ndarray


def shard_of(texts: list[np.ndarray]) -> Block:
    """The words of whole texts; texts end pieces."""
    data = _LOWER[np.concatenate([p for t in texts for p in (t, np.frombuffer(b"\n", np.uint8))])] if texts else np.zeros(0, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_ENDS_WORD[data]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1).astype(np.int32), np.flatnonzero(edge == -1).astype(np.int32)
    piece = np.searchsorted(np.flatnonzero(_ENDS_PIECE[data]).astype(np.int32), start).astype(np.int32)
    joined = np.zeros(len(piece), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return Block(byte_hashes(data, start, end), joined, data, start, end)


def runs(shard: Shard, k: int) -> np.ndarray:
    """Whether ``k`` words from each word on lie in one piece."""
    n = max(0, len(shard.joined) - k + 1)
    whole = np.ones(n, bool)
    for i in range(k - 1):
        whole &= shard.joined[i : n + i]
    return whole


@dataclass
class Shipped:
    """A set of hashes in all tasks: exact, or a Bloom filter."""

    hashes: np.ndarray | None
    bits: np.ndarray | None = None
    power: int = 0

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.logical_and.reduce([self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 for at in filter_places(hashes, self.power)]).astype(bool)
        if not len(self.hashes):
            return np.zeros(len(hashes), bool)
        at = np.searchsorted(self.hashes, hashes)
        return self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes


def filter_places(hashes: np.ndarray, power: int) -> list[np.ndarray]:
    """Four places of each hash in a filter of 2^power bits."""
    with np.errstate(over="ignore"):
        return [(mix(hashes + np.uint64(k)) >> np.uint64(64 - power)).astype(np.int64) for k in range(4)]


#: Runs that are sorted at once, and that a class has at most in the mean, up to 128 classes.
_CLASS_WORDS = 1 << 18


def frequent(shard: Shard, support: int, longest: int, allowed=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first place, count) of every run of up to ``longest`` words found ``support`` times.

    Equal runs share a hash; they are counted class by class of the hashes, which bounds the
    memory of a count. ``good`` tells, per place, whether the run of k words there is frequent.
    ``allowed`` tells of places which pairs of words may be part of longer runs.
    """
    n = len(shard.word)
    power = min(7, (n // _CLASS_WORDS).bit_length())
    good = np.zeros(0, bool)
    for k in range(1, longest + 1):
        whole = runs(shard, k)
        if k > 1:
            whole &= good[:-1] & good[1:]
        # The class of each place; 255 if no run to count begins there.
        group = np.full(len(whole), 255, np.uint8)
        for at in range(0, len(whole), _CLASS_WORDS):
            places = np.flatnonzero(whole[at : at + _CLASS_WORDS]) + at
            group[places] = (windows_at(shard.word, k, places) & np.uint64((1 << power) - 1)).astype(np.uint8)
        good, found = np.zeros(len(whole), bool), []
        del whole
        for c in range(1 << power):
            places = np.flatnonzero(group == c).astype(np.int32)
            if not len(places):
                continue
            # A run that recurs without end makes its class large, so that is sorted in slices.
            parts = []
            for at in range(0, len(places), _CLASS_WORDS):
                part = places[at : at + _CLASS_WORDS]
                values, inverse = np.unique(windows_at(shard.word, k, part), return_inverse=True)
                parts.append((part, values, inverse.astype(np.int32)))
            if len(parts) > 1:
                values = np.unique(np.concatenate([v for _, v, _ in parts]))
                parts = [(part, values, np.searchsorted(values, v).astype(np.int32)[inverse]) for part, v, inverse in parts]
            count, first = np.zeros(len(values), np.int64), np.full(len(values), n, np.int32)
            for part, _, inverse in parts:
                count += np.bincount(inverse, minlength=len(values))
                np.minimum.at(first, inverse, part)
            keep = count >= support
            if not keep.any():
                continue
            found.append((first[keep], count[keep]))
            if k == 2 and allowed is not None:
                keep[keep] = allowed(first[keep])
            for part, _, inverse in parts:
                good[part] = keep[inverse]
        if not found:
            return
        yield k, np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found])


def salted(hashes: np.ndarray, lang: str) -> np.ndarray:
    """Phrase hashes that differ between languages."""
    return hashes ^ np.frombuffer(hashlib.md5(lang.encode()).digest()[:8], np.uint64)[0]


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[str, Block]]:
    """A partition's documents as blocks of bounded size (or one longer document)."""
    waiting: dict[str, list[np.ndarray]] = {}
    held: dict[str, int] = {}
    # A word takes two bytes at least, its end included, and some six in prose.
    most = 6 * words
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for i, lang in enumerate(batch.column("lang").to_pylist()):
            text = data[offsets[i] : offsets[i + 1]].copy()
            waiting.setdefault(lang, []).append(text)
            held[lang] = held.get(lang, 0) + len(text)
            if held[lang] >= most:
                yield lang, shard_of(waiting.pop(lang))
                held[lang] = 0
            elif sum(held.values()) >= 2 * most:
                largest = max(held, key=held.get)
                yield largest, shard_of(waiting.pop(largest))
                held[largest] = 0
    for lang, texts in waiting.items():
        yield lang, shard_of(texts)


def _shards(batches: Iterator[pa.RecordBatch], settings: PhraseSettings) -> Iterator[tuple[str, Shard]]:
    """A partition's words as few shards of bounded size, one a language where they fit."""
    waiting: dict[str, list[Shard]] = {}
    held: dict[str, int] = {}

    def whole(lang):
        n, parts = held.pop(lang), waiting.pop(lang)[::-1]
        shard, at = Shard(np.empty(n, np.uint64), np.empty(n, bool)), 0
        while parts:  # each is freed as soon as it is copied
            part = parts.pop()
            end = at + len(part.word)
            shard.word[at:end], shard.joined[at:end] = part.word, part.joined
            at = end
        return lang, shard

    # Blocks are smaller here, where more is held besides.
    for lang, block in _blocks(batches, min(settings.block_words, settings.shard_words) // 4):
        if len(block.word):
            waiting.setdefault(lang, []).append(Shard(block.word, block.joined))
            held[lang] = held.get(lang, 0) + len(block.word)
        del block
        if sum(held.values()) >= settings.shard_words:
            yield whole(max(held, key=held.get))
    for lang in [*held]:
        yield whole(lang)


def _local_support(n: int, lang: str, totals: dict[str, int], settings: PhraseSettings) -> int:
    return max(1, -(-settings.support * n // totals[lang]))


_MINED = "lang string, id long, k int, c long, slack long"


def _mined(batches: Iterator[pa.RecordBatch], totals: dict[str, int], pairs: Shipped | None, settings: PhraseSettings) -> Iterator[pa.RecordBatch]:
    """Per shard its frequent words and pairs, or its longer runs over ``pairs``, with their
    counts; and a row of k = 0. ``slack`` is what a phrase not reported may count at most."""

    def batch_of(lang, ids, k, counts, slack):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([lang] * n), pa.array(ids, pa.int64()), pa.array(np.full(n, k, np.int32)), pa.array(counts, pa.int64()), pa.array(np.full(n, slack))],
                                          ["lang", "id", "k", "c", "slack"])

    for lang, shard in _shards(batches, settings):
        support = _local_support(len(shard.word), lang, totals, settings)
        yield batch_of(lang, [0], 0, [0], support - 1)
        ids = lambda places, k: salted(windows_at(shard.word, k, places), lang)  # noqa: E731, B023
        allowed = None if pairs is None else lambda places: pairs.has(ids(places, 2))  # noqa: B023
        for k, first, count in frequent(shard, support, 2 if pairs is None else settings.longest, allowed):
            if (k > 2) == (pairs is not None):
                for at in range(0, len(first), 100_000):
                    part = slice(at, at + 100_000)
                    yield batch_of(lang, ids(first[part], k).view(np.int64), k, count[part], support - 1)


_COUNTED = "lang string, id long, k int, f long, phrase binary"


def _counts(block: Block, lang: str, wanted: Shipped, support: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(k, ids, counts, phrases) of the wanted phrases in a block; a phrase is told from ``support`` on."""
    text, hit = memoryview(block.data), np.zeros(0, bool)
    for k in range(1, longest + 1):
        whole = runs(block, k)
        if k > 1:
            # All parts of a frequent phrase are frequent, so they are wanted too.
            whole &= hit[:-1] & hit[1:]
        found = []
        for at in range(0, len(whole), _CLASS_WORDS):
            places = np.flatnonzero(whole[at : at + _CLASS_WORDS]) + at
            hashes = salted(windows_at(block.word, k, places), lang)
            known = wanted.has(hashes)
            found.append((places[known].astype(np.int32), hashes[known]))
        places, hashes = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.uint64))
        if not len(places):
            return
        hit = np.zeros(len(whole), bool)
        hit[places] = True
        ids, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        first = places[first]
        spans = zip(block.start[first].tolist(), block.end[first + k - 1].tolist(), (counts >= support).tolist())
        # Words of one piece are parted by blanks and tabs alone.
        phrases = (b" ".join(p for p in bytes(text[a:b]).replace(b"\t", b" ").split(b" ") if p) if told else None for a, b, told in spans)
        yield k, ids.view(np.int64), counts, pa.array(phrases, pa.binary())


def _together(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, counts, phrases) of several blocks with each id once."""
    ids, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    phrases = pa.concat_arrays([p[2] for p in parts])
    order = np.lexsort((phrases.is_null().to_numpy(zero_copy_only=False), ids))
    begin = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0))
    return ids[order[begin]], np.add.reduceat(counts[order], begin), phrases.take(pa.array(order[begin]))


#: Counts of blocks that a task holds before it unites them, and reports them if most differ.
_HELD_COUNTS = 1_200_000


def _counted(batches: Iterator[pa.RecordBatch], totals: dict[str, int], wanted: Shipped, settings: PhraseSettings) -> Iterator[pa.RecordBatch]:
    """The task's counts of the wanted phrases, with the phrase where it is frequent in a block."""
    held: dict[tuple[str, int], list] = {}
    n = 0

    def reports():
        for (lang, k), parts in held.items():
            ids, counts, phrases = _together(parts)
            for at in range(0, len(ids), 50_000):
                part = slice(at, at + 50_000)
                m = len(ids[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * m), pa.array(ids[part]), pa.array(np.full(m, k, np.int32)), pa.array(counts[part]), phrases[part]],
                    ["lang", "id", "k", "f", "phrase"])

    for lang, block in _blocks(batches, min(settings.block_words, settings.shard_words)):
        if not len(block.word):
            continue
        support = _local_support(len(block.word), lang, totals, settings)
        for k, *counts in _counts(block, lang, wanted, support, settings.longest):
            parts = held.setdefault((lang, k), [])
            parts.append(tuple(counts))
            n += len(counts[0])
        if n >= _HELD_COUNTS:
            for key, parts in held.items():
                held[key] = [_together(parts)]
            n = sum(len(parts[0][0]) for parts in held.values())
        if n >= _HELD_COUNTS * 2 // 3:
            yield from reports()
            held, n = {}, 0
    yield from reports()


def _union(mined: DataFrame, settings: PhraseSettings) -> DataFrame:
    """(lang, id, k): the reported phrases that may be frequent in the whole."""
    reports = saved(mined.groupBy("lang", "id", "k").agg(F.sum("c").alias("c"), F.sum("slack").alias("slack")))
    # One row per language, as the totals that the driver holds.
    every = F.broadcast(reports.where("k = 0").select("lang", F.col("slack").alias("all_slack")))
    return saved(reports.where("k > 0").join(every, "lang").where(F.col("c") + F.col("all_slack") - F.col("slack") >= settings.support).select("lang", "id", "k"))


def _filter_words(batches: Iterator[pa.RecordBatch], power: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.concatenate(filter_places(batch.column("id").to_numpy().view(np.uint64), power))
        yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(np.int64(1) << (at & 31))], ["word", "bits"])


def shipped(ids: DataFrame, settings: PhraseSettings) -> Shipped:
    """The ids (saved), as a set of bounded size."""
    if ids.count() <= settings.shipped:
        return Shipped(np.sort(ids.select("id").toPandas()["id"].to_numpy(np.int64).view(np.uint64)))
    power = settings.filter_bits
    marked = ids.select("id").mapInArrow(lambda batches: _filter_words(batches, power), "word long, bits long")
    marked = saved(marked.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")))
    table = np.zeros(1 << (power - 5), np.uint32)
    for piece in range(16):  # of at most 2^(power - 9) rows each
        rows = marked.where(F.col("word") % 16 == piece).toPandas()
        table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).astype(np.uint32)
    return Shipped(None, table.view(np.uint8), power)


def phrase_counts(docs: DataFrame, settings: PhraseSettings = PRODUCTION) -> tuple[DataFrame, DataFrame]:
    """((lang, n), (lang, k, phrase, f)): words of each language, and every phrase of 1 to
    ``longest`` words with f >= ``support``."""
    word = F.lit("[^\\x20\\x09.,;:!?\\x0A-\\x0D]+")
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    totals = saved(rows.groupBy("lang").agg(F.sum(F.regexp_count("text", word).cast("long")).alias("n")).where("n > 0"))
    # One number per language goes to the tasks.
    known = {r["lang"]: r["n"] for r in totals.collect()}
    # Few large shards prune better than many small ones.
    partitions = -(-4 * sum(known.values()) // (3 * settings.shard_words))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shards = rows.coalesce(max(int(partitions), cores, 1))
    short = _union(shards.mapInArrow(lambda batches: _mined(batches, known, None, settings), _MINED), settings)
    pairs = shipped(short.where("k = 2"), settings)
    long = _union(shards.mapInArrow(lambda batches: _mined(batches, known, pairs, settings), _MINED), settings)
    candidates = saved(short.unionByName(long))
    wanted = shipped(candidates, settings)
    counted = shards.mapInArrow(lambda batches: _counted(batches, known, wanted, settings), _COUNTED)
    if wanted.bits is not None:
        counted = counted.join(candidates.select("lang", "id"), ["lang", "id"])
    counted = counted.groupBy("lang", "id", "k").agg(F.sum("f").alias("f"), F.min(F.col("phrase").cast("string")).alias("phrase"))
    return totals, saved(counted.where(F.col("f") >= settings.support).select("lang", "k", "phrase", "f"))


def collocations(docs: DataFrame, settings: PhraseSettings = PRODUCTION) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its lowest-scoring cut, ``n`` the
    language's words. Phrases inside an equally frequent longer candidate are left out. A
    null text is empty, a null language ``und``; empty texts and languages without words give
    nothing. Long texts are read whole; one above a shard's bound is a shard. Ties go to the
    earlier cut and the smaller phrase; repeated rows count each time. Other columns
    are ignored; an empty table gives no rows. Products are decimals of 38 digits.
    """
    totals, counts = phrase_counts(docs, settings)
    words = F.split("phrase", " ")
    candidates = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "a", words.alias("w"), F.posexplode(F.sequence(F.lit(1), F.col("k") - 1)).alias("_", "cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("cut") + 1, F.size("w") - F.col("cut")), " ").alias("right"))
    side = counts.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = cuts.join(side.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(side.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # totals has one row per language, all of which the driver has seen.
    cuts = cuts.join(F.broadcast(totals), "lang")
    score = F.expr("cast(cast(1000 * cast(a as decimal(18, 0)) as decimal(21, 0)) * cast(n as decimal(17, 0)) as decimal(38, 0)) div cast(cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)) as decimal(38, 0))")
    lowest = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "n")).alias("low"))
    inner = F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))
    # A phrase as frequent as a longer one is as frequent as all between them.
    longer = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = lowest.join(longer, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * low.a").select("lang", "phrase", "low.*")
    rank = F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)")
    return left.withColumn("rank", rank.cast("long")).where(F.col("rank") <= settings.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases_sql(settings: PhraseSettings = PRODUCTION) -> str:
    """The same result as SQL over documents: all runs of words counted at once."""
    m = settings.longest
    grams = " union all ".join(f"select lang, {k} k, array_to_string(w[p : p + {k - 1}], ' ') phrase from u where p + {k - 1} <= len(w)" for k in range(1, m + 1))
    return f"""
        with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\v\\f\\r]')) t from documents),
        s as (select lang, list_filter(regexp_split_to_array(t, '[ \\t]+'), lambda x: x <> '') w from p),
        u as (select lang, w, unnest(range(1, len(w) + 1)) p from s),
        n as (select lang, count(*) n from u group by lang),
        g as ({grams}),
        f as (select lang, k, phrase, count(*) f from g group by all having count(*) >= {settings.support}),
        c as (select lang, phrase, k, f a, string_split(phrase, ' ') w, unnest(range(1, k)) cut from f where k > 1),
        z as (select c.lang, c.phrase, c.a, cut, l.f l, r.f r, n, (1000::hugeint * c.a * n) // (l.f::hugeint * r.f) score
              from c join f l on l.lang = c.lang and l.phrase = array_to_string(w[1 : cut], ' ')
              join f r on r.lang = c.lang and r.phrase = array_to_string(w[cut + 1 : c.k], ' ') join n on n.lang = c.lang),
        low as (select * from z qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        inside as (select distinct q.lang, array_to_string(string_split(q.phrase, ' ')[i : i + j - 1], ' ') phrase, q.f
                   from f q, range(1, {m}) t(i), range(2, {m}) v(j) where i + j - 1 <= q.k and j < q.k),
        gone as (select distinct low.lang, low.phrase from low join inside using (lang, phrase) where 100 * inside.f >= 100 * low.a)
        select lang, rank, phrase, a, l, r, n, score::bigint score from (
            select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from low anti join gone using (lang, phrase))
        where rank <= {settings.top}
    """
