"""Repeated line runs by a suffix array over sequences of line ids, and their removal.

A document is the sequence of ids of its lines that have a word; its end sorts before any
line. Distributed prefix doubling orders the suffixes: a suffix's rank among those that
share its first h lines follows from the ranks, h lines on, of the distinct pairs, which
are counted first and then sorted by range with running totals. Suffixes that are alone
in their class, or end inside it, have their place and drop out, so rounds shrink with
the text that still repeats.

Neighbours of one class that part in a round share at least h and less than 2h lines; how
many, the ranks of earlier rounds tell from the largest half down. A class of suffixes
that share min_lines lines is an interval of the array whose common prefixes are at least
that long: its first suffix in the order of documents stays, and the min_lines lines of
each later one go. The union of these over all intervals is what lies in repeated runs. With
min_lines 1 the classes are those of equal lines, from before the first doubling.

Documents with the same lines enter as one: the first of them stands for the others, whose
lines are all later copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import WORD, broadcastable, saved, shuffle_partitions

#: A document: its id (nulls last) and a hash of id and text.
DOC = ["place", "key"]
_PAIR = ["line", "sub", "next_line", "next_sub"]


@dataclass(frozen=True)
class LineSettings:
    min_lines: int = 1  # a power of two
    broadcast_ids: int = 500_000  # of repeated lines or documents, some 40 bytes each

    def __post_init__(self):
        if self.min_lines < 1 or self.min_lines & (self.min_lines - 1):
            raise ValueError("min_lines must be 1, 2, 4 ...")


PRODUCTION = LineSettings()


def _identified(docs: DataFrame) -> DataFrame:
    """Rows with what names their document, the digest of its lines that have a word, and their number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("place"), F.xxhash64("doc_id", "text").alias("key"))
    worded = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    return rows.withColumns({"lines_md5": F.unhex(F.md5(F.array_join(worded, "\n"))), "n_worded": F.size(worded)})


def _with_first(rows: DataFrame, settings: LineSettings) -> DataFrame:
    """``rows`` (identified) with, where several documents have the same lines, the first of them."""
    documents = rows.where("n_worded > 0").groupBy("lines_md5").agg(F.min(F.struct(*DOC)).alias("first_doc"), F.max(F.struct(*DOC)).alias("last_doc"))
    shared = saved(documents.where("first_doc != last_doc").select("lines_md5", "first_doc"))
    return rows.join(broadcastable(shared, settings.broadcast_ids), "lines_md5", "left").drop("lines_md5")


def line_sequences(rows: DataFrame) -> DataFrame:
    """(place, key, at, n, line): every line's position, place among those with a word, id.

    Lines without a word have neither n nor id. Rows that repeat id and text are one
    document.
    """
    lines = rows.select(*DOC, F.posexplode(F.split("text", "\n")).alias("at", "content"))
    lines = lines.select(*DOC, "at", F.when(F.col("content").rlike(WORD), F.xxhash64("content")).alias("line"))
    lines = lines.repartition(shuffle_partitions(rows.sparkSession), *DOC).dropDuplicates([*DOC, "at"])
    before = F.expr("count(line) over (partition by place, key order by at) - 1")
    return lines.withColumn("n", F.when(F.col("line").isNotNull(), before))


def ranked_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with their number in order, and the rank their members get within (line, sub).

    Sorted by range; totals within ranges are moved by those of the ranges before, of which
    there is one row per range. A class that began in an earlier range takes its start from
    there, as the last start before this range.
    """
    def within(column: str) -> Column:
        return F.coalesce(F.expr(f"sum({column}) over (partition by part order by {', '.join(_PAIR)} rows between unbounded preceding and 1 preceding)"), F.lit(0))

    ranged = pairs.repartitionByRange(shuffle_partitions(pairs.sparkSession), *_PAIR).withColumn("part", F.spark_partition_id())
    ranged = ranged.withColumns({"smaller": within("members"), "number": F.expr(f"row_number() over (partition by part order by {', '.join(_PAIR)}) - 1").cast("long")})
    ranged = saved(ranged.withColumn("start", F.expr(f"first_value(smaller) over (partition by part, line, sub order by {', '.join(_PAIR)})")))
    sums = ranged.groupBy("part").agg(
        F.sum("members").alias("all"), F.count("*").alias("rows"),
        F.min(F.struct("line", "sub")).alias("head"), F.max(F.struct("line", "sub", "start")).alias("last"))
    before = "over (order by part rows between unbounded preceding and 1 preceding)"
    sums = sums.select(
        "part", "head", "last", F.expr(f"coalesce(sum(all) {before}, 0)").alias("base"), F.expr(f"coalesce(sum(rows) {before}, 0)").alias("base_number"),
        F.expr("lag(struct(last.line, last.sub)) over (order by part)").alias("tail"))
    # A range's last class has its start here unless it fills the range and began before it.
    goes_on = F.col("head").eqNullSafe(F.col("tail"))
    begun = F.when(~(goes_on & (F.struct("last.line", "last.sub") == F.col("head"))), F.col("base") + F.col("last.start"))
    sums = sums.withColumns({"goes_on": goes_on, "begun": begun})
    sums = sums.select("part", "base", "base_number", F.when(F.col("goes_on"), F.col("head")).alias("open_class"),
                       F.expr(f"last_value(begun, true) {before}").alias("open_start"))
    joined = ranged.join(F.broadcast(sums), "part")
    start = F.when(F.struct("line", "sub") == F.col("open_class"), F.col("open_start")).otherwise(F.col("base") + F.col("start"))
    return joined.withColumns({
        "new_sub": F.col("sub") + F.col("base") + F.col("smaller") - start, "number": F.col("number") + F.col("base_number"),
    }).drop("part", "start", "smaller", "base", "base_number", "open_class", "open_start")


@dataclass
class Round:
    """One doubling: live suffixes with their rank (line, sub) among those sharing ``lines``
    lines and what their pair of ranks has, and the distinct (rank, rank ``lines`` on) with
    the rank they get."""

    lines: int
    live: DataFrame
    pairs: DataFrame


def repeated_lines(sequences: DataFrame) -> DataFrame:
    """(line, first): lines found twice or more, with the place of the first in the order of documents."""
    worded = sequences.where("line is not null")
    times = worded.groupBy("line").agg(F.count("*").alias("times"), F.min(F.struct(*DOC, "n")).alias("first"))
    return saved(times.where("times > 1").select("line", "first"))


def prefix_doubling(sequences: DataFrame, repeated: DataFrame, settings: LineSettings = PRODUCTION) -> Iterator[Round]:
    """The rounds until every suffix has its place."""
    worded = sequences.where("line is not null").select(*DOC, "n", "line")
    again = broadcastable(repeated.select("line", F.lit(True).alias("again")), settings.broadcast_ids)
    state = worded.join(again, "line", "left").select(
        *DOC, "n", "line", F.lit(0).cast("long").alias("sub"), F.coalesce("again", F.lit(False)).alias("live"))
    lines = 1
    while True:
        over = "over (partition by place, key order by n)"
        seen = state.select(
            *DOC, "n", "line", "sub", "live",
            F.expr(f"lead(line, {lines}) {over}").alias("next_line"), F.expr(f"lead(sub, {lines}) {over}").alias("next_sub"),
            F.expr("count(*) over (partition by place, key)").alias("length"),
            F.expr("max(live) over (partition by place, key)").alias("any_live"),
        ).where("any_live").drop("any_live")
        seen = saved(seen)
        live = seen.where("live").drop("live")
        if live.isEmpty():
            return
        pairs = live.groupBy(*_PAIR).agg(F.count("*").alias("members"), F.min(F.struct(*DOC, "n")).alias("first"))
        placed = ranked_pairs(pairs)
        told = saved(_with_pair(live, placed.select(*_PAIR, "new_sub", "members", "first")))
        yield Round(lines, told, placed.select("number", "line", "sub", "first"))
        state = seen.where("not live").select(*DOC, "n", "line", "sub", "live").unionByName(
            told.select(*DOC, "n", "line", F.col("new_sub").alias("sub"), ((F.col("members") > 1) & F.col("next_line").isNotNull()).alias("live")))
        lines *= 2


def _with_pair(live: DataFrame, pairs: DataFrame) -> DataFrame:
    other = pairs.withColumnsRenamed({c: f"_{c}" for c in _PAIR})
    same = F.lit(True)
    for c in _PAIR:
        same = same & live[c].eqNullSafe(other[f"_{c}"])
    return live.join(other, same).drop(*(f"_{c}" for c in _PAIR))


def common_prefixes(rounds: list[Round]) -> DataFrame:
    """(place, key, lines): for suffixes next to each other, how many lines they share."""
    found, open_pairs = [], None
    for level in reversed(rounds):
        # Pairs parted on the way down look up this level's ranks where they stand.
        if open_pairs is not None:
            for side in ("p", "q"):
                at = level.live.select(F.col("place").alias(f"{side}_place"), F.col("key").alias(f"{side}_key"), F.col("n").alias("stand"), F.struct("line", "sub").alias(f"{side}_rank"))
                open_pairs = open_pairs.withColumn("stand", F.col(f"{side}_n") + F.col("lines")).join(at, [f"{side}_place", f"{side}_key", "stand"], "left").drop("stand")
            more = F.when(F.col("p_rank") == F.col("q_rank"), level.lines).otherwise(0)
            open_pairs = saved(open_pairs.withColumn("lines", F.col("lines") + more).drop("p_rank", "q_rank"))
        own = level.pairs
        left = own.select((F.col("number") + 1).alias("number"), "line", "sub", F.col("first").alias("p"))
        parted = left.join(own.withColumnRenamed("first", "q"), ["number", "line", "sub"]).select(
            *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "pq" for c in (*DOC, "n")), F.lit(level.lines).alias("lines"))
        open_pairs = parted if open_pairs is None else open_pairs.unionByName(parted)
        # Suffixes that end together inside a class share all they have.
        ended = level.live.where("members > 1 and next_line is null")
        found.append(ended.select(*DOC, (F.col("length") - F.col("n")).cast("int").alias("lines")))
    sides = F.explode(F.array(*(F.struct(F.col(f"{s}_place").alias("place"), F.col(f"{s}_key").alias("key")) for s in "pq")))
    out = open_pairs.select(sides.alias("doc"), "lines").select("doc.*", "lines")
    for more in found:
        out = out.unionByName(more)
    return out


def line_dedup(docs: DataFrame, settings: LineSettings = PRODUCTION) -> DataFrame:
    """One row per row of ``docs``: doc_id, text without later copies of repeated line
    runs, n_lines, n_deleted, longest_run (lines of its longest run found again).

    A run counts from min_lines lines with a word on; lines without a word neither count
    nor go. The first copy in the order of doc_id (nulls last), then of a hash of the
    text, then of the line stays. Copies inside one document count, also where they
    overlap. ``docs`` needs doc_id and text; other columns are ignored. A null text
    counts as empty and comes back empty. Rows that repeat id and text are one document
    and get equal results. An empty table gives no rows. Texts of any length are read whole.
    Lines are told apart by 64-bit hashes, documents with the same lines found by 128-bit ones.
    """
    rows = _with_first(_identified(docs), settings)
    later = F.col("first_doc").isNotNull() & (F.struct(*DOC) != F.col("first_doc")) & (F.col("n_worded") >= settings.min_lines)
    sequences = saved(line_sequences(rows.where(~later)))
    repeated = repeated_lines(sequences)
    rounds = list(prefix_doubling(sequences, repeated, settings))
    gone = _later_copies(sequences, repeated, rounds, settings)
    if gone is None or not rounds:
        return _cut(rows, None, later)
    gone = saved(gone)
    touched = gone.select(*DOC).distinct()
    flagged = sequences.join(touched, DOC, "left_semi").join(gone, [*DOC, "n"], "left")
    flags = flagged.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("gone", F.lit(False)).alias("gone")))).alias("flags"))
    longest = common_prefixes(rounds).groupBy(*DOC).agg(F.max("lines").alias("longest_run"))
    return _cut(rows, saved(longest.join(flags, DOC, "full_outer")), later)


def _later_copies(sequences: DataFrame, repeated: DataFrame, rounds: list[Round], settings: LineSettings) -> DataFrame | None:
    """(place, key, n, gone): the lines in later copies of runs of min_lines lines."""
    if settings.min_lines == 1:
        worded = sequences.where("line is not null").join(broadcastable(repeated, settings.broadcast_ids), "line")
        later = worded.where(F.struct(*DOC, "n") != F.col("first"))
        return later.select(*DOC, "n", F.lit(True).alias("gone"))
    for r in rounds:
        if 2 * r.lines == settings.min_lines:
            later = r.live.where("members > 1 and next_line is not null").where(F.struct(*DOC, "n") != F.col("first"))
            runs = later.select(*DOC, F.explode(F.sequence(F.col("n"), F.col("n") + settings.min_lines - 1)).alias("n"))
            return runs.distinct().withColumn("gone", F.lit(True))
    return None


def _cut(rows: DataFrame, told: DataFrame | None, later: Column) -> DataFrame:
    """Later documents of the same lines keep the lines without a word; the others lose what is flagged."""
    lines = F.split("text", "\n")
    blank = F.array_join(F.filter(lines, lambda line: ~line.rlike(WORD)), "\n")
    if told is None:
        told = rows.select(*DOC, F.lit(0).alias("longest_run"), F.lit(None).cast("array<struct<at:int,gone:boolean>>").alias("flags")).where("false")
    kept = F.filter(F.zip_with(lines, F.col("flags"), lambda x, f: F.when(~f["gone"], x)), lambda x: x.isNotNull())
    text = F.when(later, blank).when(F.col("flags").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_deleted = F.when(later, F.col("n_worded")).when(F.col("flags").isNull(), 0).otherwise(F.size(F.filter("flags", lambda f: f["gone"])))
    longest = F.when(F.col("first_doc").isNotNull(), F.col("n_worded")).otherwise(F.coalesce("longest_run", F.lit(0)))
    return rows.join(told, DOC, "left").select(
        "doc_id", text.alias("text"), F.size(lines).alias("n_lines"), n_deleted.alias("n_deleted"), longest.alias("longest_run"))


def dedup_sql(min_lines: int = 1) -> str:
    """The same result, by brute force, as SQL over documents (its rows must be distinct)."""
    word = "[^ \\t\\n\\v\\f\\r]"
    same = "".join(f", lead(line, {k}) over w l{k}" for k in range(1, min_lines))
    keys = ", ".join(["line", *(f"l{k}" for k in range(1, min_lines))])
    whole = f"l{min_lines - 1} is not null" if min_lines > 1 else "true"
    return f"""
        with recursive d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
        a as (select r, doc_id, line, pos from (select r, doc_id, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) - 1 pos from d)),
        s as (select r, doc_id, pos, line, row_number() over (partition by r order by pos) - 1 n from a where regexp_matches(line, '{word}')),
        win as (select r, doc_id, n, line{same} from s window w as (partition by r order by n)),
        later as (select r, n from (select *, row_number() over (partition by {keys} order by doc_id, n) i from win where {whole}) where i > 1),
        gone as (select distinct s.r, s.pos from s join later on s.r = later.r and s.n between later.n and later.n + {min_lines - 1}),
        run as (
            select r, n, 1 m, md5(line) g from (select *, count(*) over (partition by line) c from s) where c > 1
            union all
            select r, n, m + 1, md5(g || nl) from (
                select run.*, s.line nl, count(*) over (partition by run.m, run.g, s.line) c from run join s on s.r = run.r and s.n = run.n + run.m) where c > 1),
        longest as (select r, max(m) m from run group by r),
        kept as (select a.r, count(*)::int n_lines, count(gone.r)::int n_deleted, coalesce(string_agg(a.line, chr(10) order by a.pos) filter (gone.r is null), '') t
                 from a left join gone on a.r = gone.r and a.pos = gone.pos group by a.r)
        select doc_id, n_lines, n_deleted, coalesce(longest.m, 0)::int longest_run, sha256(kept.t) kept_sha256
        from d join kept using (r) left join longest using (r)
    """
