"""Quality rules whose cutoffs are certified on labelled holdouts.

Every rule is a ratio of the text in thousandths; a document is rejected where the ratio
exceeds the rule's cutoff for its stratum. A joint cutoff, one for every rule, is
admissible if an exact binomial test on the stratum's good holdout documents shows that
all its rules together reject less than the false-rejection limit. Joint cutoffs are
tested in one order, from the most lenient to the strictest, that is fixed without a look
at labels, and testing stops at the first failure (fixed-sequence testing); over strata
the level is divided by their number (Bonferroni). So with probability 1 - level, no
stratum loses more than the limit of its good documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.common import WHITE, saved
from loomgraph.llm.hashing import SLICE_BYTES, buffers, windows, word_hashes

#: Rule -> numerator and denominator among the measures.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "capitals": ("n_capitals", "word_chars"),
    "shouts": ("n_shouts", "word_chars"),
}
#: Cutoffs tried, in thousandths, most lenient first.
CUTOFFS = (900, 800, 700, 600, 500, 400, 300, 200, 150, 100, 50, 20, 10, 5)
#: Strictest cutoff of each rule in the first turn, in the order in which rules are tightened:
#: what running prose keeps below; the second turn goes on to the strictest cutoff of all.
FIRST_TURN = {"symbols": 10, "shouts": 20, "dup_lines": 300, "capitals": 200, "repeats": 400}


def _joint_cutoffs() -> list[dict[str, int]]:
    steps: list[dict[str, int]] = []
    for turn in (lambda rule, cutoff: cutoff >= FIRST_TURN[rule], lambda rule, cutoff: cutoff < FIRST_TURN[rule]):
        for rule in FIRST_TURN:
            for cutoff in CUTOFFS:
                if turn(rule, cutoff):
                    steps.append((steps[-1] if steps else {}) | {rule: cutoff})
    return steps


#: The joint cutoffs in their order: each tightens one rule of the one before; a rule without a cutoff is off.
JOINT_CUTOFFS = _joint_cutoffs()


@dataclass(frozen=True)
class RiskSettings:
    limit: float = 0.02  # largest share of a stratum's good documents that may go
    level: float = 0.05  # chance that any stratum exceeds it
    cost: int = 5  # bad documents a rejected good one must be worth
    broadcast_strata: int = 10_000


PRODUCTION = RiskSettings()

_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_shouts")
_WHITE_BYTES = WHITE.encode()


def _flags(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], np.int8)


_BYTE_FLAGS = {
    "word_chars": _flags(lambda b: bytes([b]) not in _WHITE_BYTES and b & 0xC0 != 0x80),
    "n_symbols": _flags(lambda b: b in b"#*$%&|<>"),
    "n_capitals": _flags(lambda b: 65 <= b <= 90),
    "n_shouts": _flags(lambda b: b == 33),
}


def _counts(data: np.ndarray, offsets: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Number of flagged bytes of each text."""
    before = np.zeros(len(offsets), np.int64)
    done, base = 0, 0
    for at in range(0, len(data), SLICE_BYTES):
        part = np.cumsum(flags[data[at : at + SLICE_BYTES]], dtype=np.int64)
        upto = int(np.searchsorted(offsets, at + len(part), "right"))
        inside = offsets[done:upto] - at
        before[done:upto] = base + np.where(inside > 0, part[np.maximum(inside, 1) - 1], 0)
        done, base = upto, base + int(part[-1])
    return np.diff(before)


def _repeated_words(hashes: np.ndarray) -> int:
    """Words that lie in a 3-word window found at least twice."""
    seen = windows(hashes, 3)
    if len(seen) < 2:
        return 0
    _, place, times = np.unique(seen, return_inverse=True, return_counts=True)
    again = times[place] > 1
    covered = np.zeros(len(hashes), bool)
    for k in range(3):
        covered[k : len(again) + k] |= again
    return int(covered.sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        out = {m: np.zeros(n, np.int64) for m in _MEASURES}
        data, offsets = buffers(batch.column("text"))
        for name, flags in _BYTE_FLAGS.items():
            out[name] = _counts(data, offsets, flags)
        for row, hashes in word_hashes(batch.column("text"), lower=False):
            lines = [x for x in data[offsets[row] : offsets[row + 1]].tobytes().split(b"\n") if x.strip(_WHITE_BYTES)]
            out["n_words"][row] = len(hashes)
            out["n_lines"][row] = len(lines)
            out["n_dup_lines"][row] = len(lines) - len(set(lines))
            out["n_repeat_words"][row] = _repeated_words(hashes)
        columns = [batch.column("doc_id"), batch.column("stratum"), *(pa.array(out[m]) for m in _MEASURES)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "stratum", *_MEASURES])


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the measures of every whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(_measure, "doc_id long, stratum string, " + ", ".join(f"{m} long" for m in _MEASURES))


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str):
    top, bottom = RULES[rule]
    return F.expr(f"case when {bottom} = 0 then 0 else {top} * 1000 / {bottom} end")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed downwards from k until terms no longer count."""
    if k >= n:
        return 1.0
    if k > n * p:  # sum the other, smaller tail
        term = math.exp(_log_term(k + 1, n, p))
        total, i = 0.0, k + 1
        while i <= n and (term > total * 1e-18 or i <= n * p):
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
            i += 1
        return 1.0 - total
    term = math.exp(_log_term(k, n, p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-18:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return total


def _log_term(k: int, n: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def admissible_cutoff(good: list[int], bad: list[int], n_good: int, limit: float, level: float, cost: int) -> int | None:
    """Index of the chosen cutoff, or None. good/bad: rejected documents per cutoff, lenient first."""
    best, value = None, 0
    for i, (g, b) in enumerate(zip(good, bad)):
        if not n_good or binomial_tail(g, n_good, limit) > level:
            break
        if b - cost * g > value:
            best, value = i, b - cost * g
    return best


def cutoffs(features: DataFrame, labels: DataFrame, settings: RiskSettings = PRODUCTION) -> DataFrame:
    """(stratum, rule, cutoff, n_good, false_rejects, bad_rejects) of each stratum's certified rules.

    The rejected documents are those of all rules of the stratum together. The holdout is every labelled document that passes the base rules. Labels other
    than 0 and 1 and labels without a document are ignored; repeated labels count once.
    """
    marked = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    holdout = features.where(~base_failed()).join(marked, "doc_id")
    # How many of the joint cutoffs, lenient first, the document passes: as many as its strictest rule lets it.
    passed = F.lit(len(JOINT_CUTOFFS))
    for rule in RULES:
        for cutoff in CUTOFFS:
            first = next(i for i, joint in enumerate(JOINT_CUTOFFS) if joint.get(rule) == cutoff)
            passed = F.least(passed, F.when(_ratio(rule) > cutoff, first))
    histogram = saved(holdout.select("stratum", "quality", passed.alias("passed")).groupBy("stratum", "passed", "quality").count())
    limit, level, cost = settings.limit, settings.level / max(1, histogram.select("stratum").distinct().count()), settings.cost

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(JOINT_CUTOFFS)
        count = np.zeros((2, n + 1), np.int64)
        np.add.at(count, (rows["quality"].to_numpy(), rows["passed"].to_numpy()), rows["count"].to_numpy())
        # Joint cutoff i rejects documents that pass at most i of them.
        rejected = count.cumsum(axis=1)[:, :n].tolist()
        n_good = int(count[1].sum())
        best = admissible_cutoff(rejected[1], rejected[0], n_good, limit, level, cost)
        chosen = [] if best is None else [[rows["stratum"].iloc[0], rule, cutoff, n_good, rejected[1][best], rejected[0][best]] for rule, cutoff in JOINT_CUTOFFS[best].items()]
        return pd.DataFrame(chosen, columns=["stratum", "rule", "cutoff", "n_good", "false_rejects", "bad_rejects"])

    return saved(histogram.groupBy("stratum").applyInPandas(
        choose, "stratum string, rule string, cutoff int, n_good long, false_rejects long, bad_rejects long"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, settings: RiskSettings = PRODUCTION, stratum: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, the measures, base_failed, kept.

    ``docs`` needs doc_id, text and the stratum column; other columns are ignored. A null
    or empty text has no words and fails the base rule. A null stratum counts as the
    empty one. A stratum with too few labels to certify anything is judged by the base
    rules alone, as are all without labels. Ratios equal to a cutoff are kept.
    """
    features = saved(measured(docs, stratum))
    chosen = cutoffs(features, labels, settings)
    by_stratum = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.max("cutoff"))
    if by_stratum.count() <= settings.broadcast_strata:
        by_stratum = F.broadcast(by_stratum)
    fits = F.lit(True)
    for rule in RULES:
        fits = fits & (F.col(rule).isNull() | (_ratio(rule) <= F.col(rule)))
    return features.join(by_stratum, "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & fits).alias("kept"),
    )
