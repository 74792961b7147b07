"""Mixing sources to target weights by entropy balancing.

Among all document rates below the cap, the mix takes those closest in entropy to one
copy of everything whose expected words per source equal the source's target. They are
exponential tilts of the document size, r = c / (1 + (c - 1) exp(-lambda_s size / mean_s))
with cap c, and lambda solves a convex dual, one Newton iteration per pass over the
(source, size) counts, all sources at once and each within a bracket. Rates are then
rounded to copies at random, by a hash of the row, with one shift per source and size
class chosen so that the words taken meet the target.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import saved, words


@dataclass(frozen=True)
class MixSettings:
    cap: int = 3
    weights: tuple[int, ...] = (1, 2, 3)
    tolerance: float = 1e-7  # of the target
    passes: int = 80
    max_sources: int = 100_000


PRODUCTION = MixSettings()

_DIGIT, _DIGITS = 6, 5
_UNIT = 2 ** (_DIGIT * _DIGITS)


@dataclass(frozen=True)
class Source:
    """What the driver knows of a source: a few numbers."""

    name: str | None
    rows: int
    size: int
    target: float = 0.0
    rate: int | None = None  # a whole rate for all its documents
    tilt: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    done: bool = False
    big_shift: int = 0
    small_shift: int = 0

    @property
    def mean(self) -> float:
        return max(1.0, self.size / max(1, self.rows))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], cap: int) -> dict[str | None, float]:
    """Target per source: all sizes shared by weight; nothing above cap times a source's size."""
    order = sorted((n for n, _ in sizes if n is not None)) + [n for n, _ in sizes if n is None]
    size = dict(sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(order)}
    left, free, out = float(sum(size.values())), list(order), {}
    while free:
        total = sum(weight[n] for n in free)
        over = [n for n in free if left * weight[n] / total > cap * size[n]]
        if not over:
            return out | {n: left * weight[n] / total for n in free}
        for n in over:
            out[n] = float(cap * size[n])
            left -= out[n]
        free = [n for n in free if n not in out]
    return out


def _same(column: str, name: str | None) -> Column:
    return F.col(column).eqNullSafe(F.lit(name))


def _plan_frame(spark, sources: list[Source]) -> DataFrame:
    """One narrow row per source; MixSettings.max_sources bounds it."""
    rows = [(s.name, s.size, s.target, s.rate, s.tilt, s.mean, s.big_shift, s.small_shift) for s in sources]
    schema = "name string, source_size long, target double, whole int, tilt double, mean double, big_shift long, small_shift long"
    return F.broadcast(spark.createDataFrame(rows, schema))


def _with_plan(rows: DataFrame, sources: list[Source]) -> DataFrame:
    plan = _plan_frame(rows.sparkSession, sources)
    return rows.join(plan, rows["source"].eqNullSafe(plan["name"])).drop("name")


def _rate(cap: int) -> Column:
    # Bounded exponent: beyond it the rate is 0 or the cap to double precision.
    push = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("mean")))
    return F.when(F.col("whole").isNotNull(), F.col("whole").cast("double")).otherwise(cap / (1 + (cap - 1) * F.exp(-push)))


def _exact_sum(column: Column) -> Column:
    """Sum in thousandths as whole numbers, so that it doesn't depend on the order of rows."""
    return F.sum(F.round(column * 1000).cast("decimal(38,0)"))


def _newton(counts: DataFrame, sources: list[Source], settings: MixSettings) -> list[Source]:
    """Tilts at which each source's expected words equal its target."""
    c = settings.cap
    for _ in range(settings.passes):
        work = [s for s in sources if not s.done]
        if not work:
            break
        taken = F.col("n") * F.col("size") * F.col("rate")
        slope = taken * F.col("size") / F.col("mean") * (1 - F.col("rate") / c)
        sums = _with_plan(counts, work).withColumn("rate", _rate(c)).groupBy("source").agg(_exact_sum(taken).alias("taken"), _exact_sum(slope).alias("slope"))
        found = {r.source: (float(r.taken) / 1000, float(r.slope) / 1000) for r in sums.collect()}
        sources = [s if s.done else _step(s, *found[s.name], settings) for s in sources]
    return sources


def _step(s: Source, taken: float, slope: float, settings: MixSettings) -> Source:
    gap = taken - s.target
    if abs(gap) <= settings.tolerance * max(1.0, s.target):
        return replace(s, done=True)
    low, high = (s.low, s.tilt) if gap > 0 else (s.tilt, s.high)
    tilt = s.tilt - gap / slope if slope > 0 else math.nan
    if not low < tilt < high or (math.isinf(low) or math.isinf(high)) and abs(tilt - s.tilt) > 4 * (1 + abs(s.tilt)):
        if math.isinf(low):
            tilt = high - 4 * (1 + abs(high))
        elif math.isinf(high):
            tilt = low + 4 * (1 + abs(low))
        else:
            tilt = (low + high) / 2
    return replace(s, tilt=tilt, low=low, high=high)


def _draw(id_column: str) -> Column:
    """A number below _UNIT that depends on the row alone."""
    return F.pmod(F.xxhash64(F.col(id_column), F.col("size"), F.lit("mix")), F.lit(_UNIT))


def _score() -> Column:
    """In [0, _UNIT): half the distance by which the rate's fraction exceeds the draw, shifted up."""
    fraction = F.floor((F.col("rate") - F.floor("rate")) * _UNIT)
    return F.shiftright(fraction - F.col("draw") + F.lit(_UNIT - 1), 1)


def _shift_search(rows: DataFrame, sources: list[Source], want: dict) -> dict:
    """Per source the score from which rates are rounded up so that ``size`` summed is nearest to want.

    ``rows`` has source, size and score. Six bits of the score are settled per pass, so a
    pass returns at most 64 numbers per source.
    """
    state = {s.name: (0, 0) for s in sources}  # prefix, words above it
    before: dict = {}
    for level in range(_DIGITS):
        low = _DIGIT * (_DIGITS - 1 - level)
        at = rows.sparkSession.createDataFrame([(n, p) for n, (p, _) in state.items()], "name string, prefix long")
        inside = rows.join(F.broadcast(at), rows["source"].eqNullSafe(at["name"])).where(F.shiftright("score", low + _DIGIT) == F.col("prefix"))
        digit = F.shiftright("score", low).bitwiseAND(2**_DIGIT - 1)
        found: dict = {}
        for r in inside.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words")).collect():
            found.setdefault(r.source, {})[r.digit] = r.words
        for name, (prefix, above) in state.items():
            digits = found.get(name, {})
            chosen, last = 0, above
            for d in range(2**_DIGIT - 1, -1, -1):
                chosen, last = d, above
                if above + digits.get(d, 0) >= want[name]:
                    break
                above += digits.get(d, 0)
            else:
                last = above - digits.get(0, 0)
            before[name] = (last, digits.get(chosen, 0))
            state[name] = ((prefix << _DIGIT) | chosen, last)
    # The rows of the last score go where the sum ends nearer.
    return {n: p if before[n][0] + before[n][1] - want[n] < want[n] - before[n][0] else p + 1 for n, (p, _) in state.items()}


def _copies() -> Column:
    shift = F.when(F.col("size") > F.col("mean"), F.col("big_shift")).otherwise(F.col("small_shift"))
    return F.when(F.col("whole").isNotNull(), F.col("whole")).otherwise((F.floor("rate") + (F.col("score") >= shift).cast("int")).cast("int"))


def mixed(docs: DataFrame, settings: MixSettings = PRODUCTION) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (0 to the cap).

    ``docs`` needs doc_id, text and source. A null or empty text has size 0 and one copy.
    A null source is a source of its own, last in the order. Reruns agree: sums are exact
    and rounding depends on (doc_id, size) alone, so repeated rows get equal copies. The
    columns named above replace columns of the same names. An empty table gives no rows.
    """
    # The row travels as one value, so that its names can't clash with the ones used here.
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), "doc_id", F.col("source").cast("string").alias("source"),
        F.size(words(F.col("text"))).cast("long").alias("size"),
    ).withColumn("draw", _draw("doc_id"))
    sized = saved(rows.select("source", "size", "draw"))
    counts = saved(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = counts.groupBy("source").agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("words"))
    totals = totals.limit(settings.max_sources + 1).collect()
    if len(totals) > settings.max_sources:
        raise ValueError(f"more than {settings.max_sources} sources")
    goal = targets([(r.source, r.words) for r in totals], settings.weights, settings.cap)
    sources = []
    for r in sorted(totals, key=lambda r: (r.source is None, r.source or "")):
        s = Source(r.source, r.rows, r.words, goal[r.source])
        if s.size == 0:
            s = replace(s, rate=1, done=True)
        elif s.target >= settings.cap * s.size:
            s = replace(s, rate=settings.cap, done=True)
        sources.append(s)
    sources = _newton(counts, sources, settings)

    open_sources = [s for s in sources if s.rate is None]
    if open_sources:
        scored = _with_plan(sized, open_sources).withColumn("rate", _rate(settings.cap)).withColumn("score", _score())
        scored = saved(scored.select("source", "size", "score", F.floor("rate").alias("floor"), (F.col("size") > F.col("mean")).alias("big")))
        whole = scored.groupBy("source").agg(F.sum(F.col("floor") * F.col("size")).alias("words"), F.sum(F.when(F.col("big"), F.col("floor") * F.col("size")).otherwise(0)).alias("big"))
        sums = {r.source: r for r in whole.collect()}
        expected = _with_plan(counts, open_sources).withColumn("rate", _rate(settings.cap)).where("size > mean")
        big_words = {r.source: float(r.words) / 1000 for r in expected.groupBy("source").agg(_exact_sum(F.col("n") * F.col("size") * F.col("rate")).alias("words")).collect()}
        # Large documents first, to their own expected words; small ones make up the rest.
        want = {s.name: big_words.get(s.name, 0.0) - sums[s.name].big for s in open_sources}
        big = _shift_search(scored.where("big"), open_sources, want)
        sources = [s if s.rate is not None else replace(s, big_shift=big[s.name]) for s in sources]
        at = _plan_frame(docs.sparkSession, [s for s in sources if s.rate is None]).select("name", "big_shift")
        up = scored.where("big").join(at, scored["source"].eqNullSafe(at["name"])).where("score >= big_shift").groupBy("source").agg(F.sum("size").alias("words"))
        ups = {r.source: r.words for r in up.collect()}
        want = {s.name: s.target - sums[s.name].words - ups.get(s.name, 0) for s in open_sources}
        small = _shift_search(scored.where("not big"), open_sources, want)
        sources = [s if s.rate is not None else replace(s, small_shift=small[s.name]) for s in sources]

    planned = _with_plan(rows, sources).withColumn("rate", _rate(settings.cap)).withColumn("score", _score())
    own = ("size", "source_size", "target", "rate", "copies")
    kept = [F.col("doc")[c].alias(c) for c in docs.columns if c not in own]
    return planned.withColumn("copies", _copies()).select(*kept, *own)


def mix_report(docs: DataFrame, settings: MixSettings = PRODUCTION) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies."""
    return mixed(docs, settings).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
