"""Passages that documents share, exactly or nearly: seeds, collinear chains, alignment.

Seeds are k-word shingles picked by winnowing: the smallest hash of every window, so any
two texts with window + k - 1 equal words in a row share a seed: 8 words as set below, so
one changed word in every 9 or more never hides a passage. With words changed at random, a
50-word passage has no seed with probability below 0.001 at 90 % equal words, 0.02 at 80 %,
0.14 at 70 % and 0.39 at 60 % (600 simulated passages each). All occurrences of a seed
meet its first one (the smallest document, then position) and the document before, never
each other.
The anchors between a document and an earlier one are chained in the order of both texts:
an anchor's score is its words plus the best score before it less a cost per skipped word,
found by a Fenwick tree over prefix maxima. Chains are cut at large gaps, and aligned word
by word: gaps are filled by longest common subsequences, ends extended while words agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.llm.common import broadcastable, saved, shuffle_partitions, words
from loomgraph.llm.hashing import windows, word_hashes


@dataclass(frozen=True)
class PassageSettings:
    seed_words: int = 5
    window: int = 4
    gap_cost: float = 0.1  # per word skipped in either text
    max_gap: int = 40  # words between neighbours of a chain
    slack: int = 3  # words that an end may skip at once while it extends
    margin: int = 24  # words around anchors that are compared first; whole texts where ends reach further
    min_segment: int = 24  # words that one source must give
    min_words: int = 50  # words of a passage, all sources together
    slice_rows: int = 100_000  # of a seed, beyond which it is dealt over slices
    slices: int = 64  # of such a seed
    sample_of: int = 64  # one document in so many is looked at for such seeds
    broadcast_seeds: int = 1_000_000  # such seeds, 9 bytes each
    min_share: float = 0.6  # of a passage's words that are equal
    broadcast_texts: int = 1_000_000


PRODUCTION = PassageSettings()


def minimizers(hashes: np.ndarray, settings: PassageSettings) -> tuple[np.ndarray, np.ndarray]:
    """(seed hashes, word positions): the smallest k-word shingle of every window of them."""
    seeds = windows(hashes, settings.seed_words)
    if not len(seeds):
        return seeds, np.zeros(0, np.int64)
    w = min(settings.window, len(seeds))
    # Windowed minimum with the rightmost position of ties, by doubling.
    best = np.arange(len(seeds))
    width = 1
    while width < w:
        step = min(width, w - width)
        left, right = best[:-step], best[step:]
        best = np.where(seeds[left] < seeds[right], left, right)
        width += step
    at = np.unique(best)
    return seeds[at], at


def _seed_rows(batches: Iterator[pa.RecordBatch], settings: PassageSettings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, parts, n = batch.column("doc_id").to_numpy(), [], 0
        for row, hashes in word_hashes(batch.column("text"), lower=True):
            seeds, at = minimizers(hashes, settings)
            parts.append((ids[row], hashes, seeds.view(np.int64), at))
            n += len(at)
            if n >= 50_000:
                yield _seed_batch(parts, settings)
                parts, n = [], 0
        if parts:
            yield _seed_batch(parts, settings)


_SEED = "doc_id long, seed long, at int, around long"


def _seed_batch(parts: list[tuple], settings: PassageSettings) -> pa.RecordBatch:
    ids, texts, seeds, at = zip(*parts)
    number, sizes = [len(a) for a in at], [len(t) for t in texts]
    end = np.cumsum(sizes)
    begin, end = np.repeat(end - sizes, number), np.repeat(end, number)
    at = np.concatenate(at)
    around = _contexts(np.concatenate(texts), begin + at, begin, end, settings)
    columns = (np.repeat(ids, number), np.concatenate(seeds), at.astype(np.int32), around)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "seed", "at", "around"])


_CODE_BITS = 3  # of a word in a context


def _context_words(settings: PassageSettings) -> int:
    """Words on either side of a seed that tell whether it goes on; 0 where a context is not wide enough.

    It goes on by more than ``slack`` words only over slack + 1 equal words in a row. They begin at most
    ``slack`` words behind the first difference, which is among the first slack + 1 words.
    """
    words_ = 3 * settings.slack + 1
    return words_ if settings.seed_words + 2 * settings.slack < settings.min_segment and 2 * words_ * _CODE_BITS < 64 else 0


def _contexts(hashes: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, settings: PassageSettings) -> np.ndarray:
    """Codes of the words behind seeds at ``at`` of texts from ``begin`` to ``end``, then of those before, nearest first.

    Equal words have equal codes of three bits, other words mostly others; 0 is where a text ends.
    """
    around, width = np.zeros(len(at), np.int64), _context_words(settings)
    codes = (hashes % np.uint64((1 << _CODE_BITS) - 1)).astype(np.int64) + 1 if width else hashes
    for n in range(width):
        for place, lane in ((at + settings.seed_words + n, n), (at - 1 - n, width + n)):
            there = (place >= begin) & (place < end)
            around |= np.where(there, codes[np.where(there, place, 0)], 0) << (_CODE_BITS * lane)
    return around


def _goes_on(one: Column, other: Column, settings: PassageSettings) -> Column:
    """Whether two texts may go on together, by more than ``slack`` words, on a side of a common seed.

    If false ``_extend`` is sure to stop there: no slack + 1 codes in a row are equal, however many are skipped.
    """
    width, need = _context_words(settings), settings.slack + 1
    if not width:
        return F.lit(True)
    behind = lambda c, lanes: F.shiftright(c, _CODE_BITS * lanes) if lanes else c
    any_bit = lambda c: reduce(Column.bitwiseOR, (F.shiftright(c, b) if b else c for b in range(_CODE_BITS)))
    found = []
    for skipped in range(-settings.slack, need):
        x, y = (one, behind(other, skipped)) if skipped >= 0 else (other, behind(one, -skipped))
        # The lowest bit of a lane: a word of x that equals the one of y.
        same = any_bit(x).bitwiseAND(F.bitwise_not(any_bit(x.bitwiseXOR(y))))
        runs = reduce(Column.bitwiseAND, (behind(same, n) for n in range(need)))
        begins = range(width - need - abs(skipped) + 1)
        lanes = sum(1 << (_CODE_BITS * (side + n)) for side in (0, width) for n in begins)
        found.append(runs.bitwiseAND(F.lit(lanes)))
    return reduce(Column.bitwiseOR, found) != 0


def best_chains(x: np.ndarray, y: np.ndarray, settings: PassageSettings) -> list[list[int]]:
    """Disjoint collinear chains of anchors (x[i], y[i]), best first, as lists of indices.

    With a cost per word skipped in either text, score - cost of a predecessor depends on
    it only through score + cost * (x + y), so the best one is a prefix maximum over y.
    """
    if len(x) == 1:
        return [[0]]
    order = np.lexsort((y, x))
    ranks = np.unique(y, return_inverse=True)[1] + 1
    size, k, cost = int(ranks.max()), settings.seed_words, settings.gap_cost
    tree: list[tuple[float, int]] = [(-np.inf, -1)] * (size + 1)
    score, before = [0.0] * len(x), [-1] * len(x)
    xs, ys, rs = x.tolist(), y.tolist(), ranks.tolist()
    waiting: list[int] = []
    for i in order.tolist():
        # Anchors of one x must not chain with each other.
        if waiting and xs[waiting[0]] < xs[i]:
            for j in waiting:
                value, r = (score[j] + cost * (xs[j] + ys[j]), j), rs[j]
                while r <= size:
                    if value > tree[r]:
                        tree[r] = value
                    r += r & -r
            waiting = []
        best, r = (-np.inf, -1), rs[i] - 1
        while r:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        score[i], j = k, best[1]
        if j >= 0:
            fresh = min(k, xs[i] - xs[j], ys[i] - ys[j])
            skipped = max(0, xs[i] - xs[j] - k) + max(0, ys[i] - ys[j] - k)
            if score[j] + fresh - cost * skipped > k:
                score[i], before[i] = score[j] + fresh - cost * skipped, j
        waiting.append(i)
    chains, used = [], [False] * len(x)
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            chains.append(chain[::-1])
    return chains


def _cut(chain: list[int], x: list[int], y: list[int], settings: PassageSettings) -> Iterator[list[int]]:
    part, last, most = chain[:1], chain[0], settings.max_gap + settings.seed_words
    for i in chain[1:]:
        if x[i] - x[last] > most or y[i] - y[last] > most:
            yield part
            part = []
        part.append(i)
        last = i
    yield part


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short runs of words."""
    first, second = a.tolist(), b.tolist()
    # Equal words at either end are part of a longest one.
    same, size = 0, min(len(first), len(second))
    while same < size and first[same] == second[same]:
        same += 1
    tail = 0
    while tail < size - same and first[-1 - tail] == second[-1 - tail]:
        tail += 1
    if same + tail == size or set(first[same : len(a) - tail]).isdisjoint(second[same : len(b) - tail]):
        return same + tail
    a, b = a[same : len(a) - tail], b[same : len(b) - tail]
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        hit = np.concatenate([[0], row[:-1] + (b == word)])
        row = np.maximum.accumulate(np.maximum(row, hit))
    return int(row[-1]) + same + tail


@lru_cache
def _skips(slack: int) -> list[tuple[int, int]]:
    """Words skipped in either text at a difference, fewest first."""
    steps = range(slack + 1)
    return sorted(((p, q) for p in steps for q in steps if p or q), key=lambda s: (s[0] + s[1], abs(s[0] - s[1])))


_NEAR = 64


def _extend_near(a: list[int], b: list[int], whole_a: bool, whole_b: bool, slack: int) -> tuple[int, int, int] | None:
    """``_extend`` from the first words of two runs; None if more words decide."""
    i = j = same = 0
    need, skips = slack + 1, _skips(slack)
    while True:
        while i < len(a) and j < len(b) and a[i] == b[j]:
            i, j, same = i + 1, j + 1, same + 1
        if not (whole_a or i + slack + need <= len(a)) or not (whole_b or j + slack + need <= len(b)):
            return None
        near_a, near_b = a[i : i + slack + need], b[j : j + slack + need]
        for p, q in () if set(near_a).isdisjoint(near_b) else skips:
            run_a = near_a[p : p + need]
            if len(run_a) == need and run_a == near_b[q : q + need]:
                i, j = i + p, j + q
                break
        else:
            return i, j, same


def _extend(a: np.ndarray, b: np.ndarray, slack: int) -> tuple[int, int, int]:
    """How far two runs go on together from their start: words of each, equal words.

    Over a difference it goes on if at least slack + 1 words then agree again.
    """
    near = _extend_near(a[:_NEAR].tolist(), b[:_NEAR].tolist(), len(a) <= _NEAR, len(b) <= _NEAR, slack)
    if near is not None:
        return near
    i = j = same = 0
    need, skips = slack + 1, _skips(slack)
    while True:
        n = min(len(a) - i, len(b) - j)
        differs = np.flatnonzero(a[i : i + n] != b[j : j + n])
        run = int(differs[0]) if len(differs) else n
        i, j, same = i + run, j + run, same + run
        near_a, near_b = a[i : i + slack + need].tolist(), b[j : j + slack + need].tolist()
        for p, q in () if set(near_a).isdisjoint(near_b) else skips:
            run_a = near_a[p : p + need]
            if len(run_a) == need and run_a == near_b[q : q + need]:
                i, j = i + p, j + q
                break
        else:
            return i, j, same


def align(part: list[int], x: list[int], y: list[int], a: np.ndarray, b: np.ndarray, settings: PassageSettings) -> tuple[int, int, int, int, int]:
    """(start, end, other start, other end, equal words) of a chain, ends exclusive."""
    k, first = settings.seed_words, part[0]
    left_a, left_b, same_left = _extend(a[: x[first]][::-1], b[: y[first]][::-1], settings.slack)
    end_a, end_b, same = x[first] + k, y[first] + k, k
    for i in part[1:]:
        over = max(0, end_a - x[i], end_b - y[i])
        if over and x[i] + over == end_a and y[i] + over == end_b:  # it goes on in both texts alike
            if over < k:
                same, end_a, end_b = same + k - over, x[i] + k, y[i] + k
        elif over < k:
            same += _common(a[end_a : x[i] + over], b[end_b : y[i] + over]) + k - over
            end_a, end_b = x[i] + k, y[i] + k
    right_a, right_b, same_right = _extend(a[end_a:], b[end_b:], settings.slack)
    return int(x[first] - left_a), int(end_a + right_a), int(y[first] - left_b), int(end_b + right_b), int(same + same_left + same_right)


def passages_between(
    x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, settings: PassageSettings = PRODUCTION, tried: list | None = None
) -> list[tuple[int, int, int, int, int]]:
    """Aligned segments of at least min_segment words, none inside another of the same chainings.

    ``tried`` gets all alignments, those too short or too different as well.
    """
    found: list[tuple[int, int, int, int, int]] = []
    chains = best_chains(x, y, settings)
    x, y = x.tolist(), y.tolist()
    for chain in chains:
        for part in _cut(chain, x, y, settings):
            first, last = x[part[0]], x[part[-1]]
            if found and any(f[0] <= first and first + settings.seed_words <= f[1] for f in found) and any(f[0] <= last < f[1] for f in found):
                continue
            one = align(part, x, y, a, b, settings)
            if tried is not None:
                tried.append(one)
            if min(one[1] - one[0], one[3] - one[2]) >= settings.min_segment and one[4] >= settings.min_share * max(one[1] - one[0], one[3] - one[2]):
                found.append(one)
    return sorted(found)


_SPANS = ("start_word", "end_word", "source_start", "source_end", "n_equal")


def _hashes_of(texts: pa.Array) -> list[np.ndarray]:
    """The word hashes of every text; a text that comes several times is hashed once."""
    encoded = texts.dictionary_encode()
    hashes = [h for _, h in word_hashes(encoded.dictionary, lower=True)]
    return [hashes[i] for i in encoded.indices.to_pylist()]


def _run(left: tuple, right: tuple, step: int, most: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words agree from places in two runs on, and whether ``_extend`` certainly stops there.

    ``left`` and ``right`` are (all words, place of each pair in them, words left from there);
    ``step`` is the direction. At most ``most`` words are looked at.
    """
    (a, at_a, left_a), (b, at_b, left_b) = left, right

    def equal(i, j) -> np.ndarray:
        there = (i < left_a) & (j < left_b)
        return there & (a[np.where(there, at_a + step * i, 0)] == b[np.where(there, at_b + step * j, 0)])

    run, going = np.zeros(len(at_a), np.int64), np.ones(len(at_a), bool)
    for t in range(most):
        going &= equal(t, t)
        run += going
    need = slack + 1
    pairs = {(p, q): equal(run + p, run + q) for p in range(slack + need) for q in range(slack + need) if abs(p - q) <= slack}
    again = [np.logical_and.reduce([pairs[p + s, q + s] for s in range(need)]) for p, q in _skips(slack)]
    return run, ~going & ~np.logical_or.reduce(again)


def _positions(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All anchors' positions in the document and in the source, and where each row's begin."""
    column = batch.column("anchors")
    fields = column.flatten()
    starts = column.offsets.to_numpy()
    at, source_at = (fields.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("at", "source_at"))
    return at, source_at, (starts - starts[0]).tolist()


def _slice_rows(batches: Iterator[pa.RecordBatch], margin: int, settings: PassageSettings) -> Iterator[pa.RecordBatch]:
    """Pairs with the hashes of the words around their anchors in the text that goes."""
    k = settings.seed_words
    for batch in batches:
        texts = _hashes_of(batch.column("text"))
        sizes = np.array([len(words_) for words_ in texts], np.int64)
        own, other, starts = _positions(batch)
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        at = np.where(batch.column("shorter").to_numpy(zero_copy_only=False)[row], own, other)
        inside = at <= sizes[row] - k  # others are of another text of the same id
        row, at = row[inside], at[inside]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        rows = row[first]
        lowest, highest = (f.reduceat(at, first) if len(first) else at for f in (np.minimum, np.maximum))
        begins, ends = np.maximum(0, lowest - margin), np.minimum(sizes[rows], highest + k + margin)
        slices = [texts[i][begin:end].tobytes() for i, begin, end in zip(rows.tolist(), begins.tolist(), ends.tolist())]
        taken = pa.array(rows, pa.int64())
        kept = [batch.column(c).take(taken) for c in ("goes", "stays", "shorter", "anchors")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(slices, pa.binary()), pa.array(begins.astype(np.int32)), pa.array(ends < sizes[rows])],
            ["goes", "stays", "shorter", "anchors", "words", "begin", "more"])


def _passage_rows(batches: Iterator[pa.RecordBatch], settings: PassageSettings) -> Iterator[pa.RecordBatch]:
    """Segments of pairs of a slice and a text; one row of nulls where the slice was too short."""
    k, near = settings.seed_words, 2 * settings.slack + 1
    for batch in batches:
        rows, spans = [], []
        shorter, begins, mores = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shorter", "begin", "more"))
        begins = begins.astype(np.int64)
        # All slices and all different texts of the batch, one after another.
        encoded = batch.column("text").dictionary_encode()
        wholes = [h for _, h in word_hashes(encoded.dictionary, lower=True)]
        whole, place = np.concatenate([*wholes, np.zeros(1, np.uint64)]), encoded.indices.to_numpy(zero_copy_only=False)
        whole_ends = np.cumsum([len(h) for h in wholes])[place] if len(place) else np.zeros(0, np.int64)
        whole_size = np.array([len(h) for h in wholes], np.int64)[place] if len(place) else np.zeros(0, np.int64)
        whole_from = whole_ends - whole_size
        parts = batch.column("words").to_pylist()
        sent, sent_size = np.frombuffer(b"".join([*parts, bytes(8)]), np.uint64), np.array([len(p) // 8 for p in parts], np.int64)
        sent_from = np.cumsum(sent_size) - sent_size
        at, source_at, starts = _positions(batch)
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        there, here = np.where(shorter[row], at, source_at) - begins[row], np.where(shorter[row], source_at, at)
        # Where an id has several texts, only anchors that lie in these two count.
        inside = (there >= 0) & (there <= sent_size[row] - k) & (here <= whole_size[row] - k)
        row, there, here = row[inside], there[inside], here[inside]
        same = np.logical_and.reduce([sent[sent_from[row] + there + j] == whole[whole_from[row] + here + j] for j in range(k)])
        row, there, here = row[same], there[same], here[same]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        number = np.diff(np.append(first, len(row)))
        # Most pairs have one seed in common and end right there: all of them are looked at together.
        lone = first[number == 1]
        r, x, y = row[lone], there[lone], here[lone]
        most = max(0, settings.min_segment - k)
        ahead, stops = _run((sent, sent_from[r] + x + k, sent_size[r] - x - k), (whole, whole_from[r] + y + k, whole_size[r] - y - k), 1, most, settings.slack)
        behind, begun = _run((sent, sent_from[r] + x - 1, x), (whole, whole_from[r] + y - 1, y), -1, most, settings.slack)
        cut = ((begins[r] > 0) & (x - behind < near)) | (mores[r] & (x + k + ahead > sent_size[r] - near))
        nothing = stops & begun & ~cut & (k + ahead + behind < settings.min_segment)
        settled = np.zeros(batch.num_rows, bool)
        settled[r[nothing]] = True
        for begin, n in zip(first.tolist(), number.tolist()):
            i = int(row[begin])
            if settled[i]:
                continue
            x, y, tried = there[begin : begin + n], here[begin : begin + n], []
            a, b = sent[sent_from[i] : sent_from[i] + sent_size[i]], whole[whole_from[i] : whole_ends[i]]
            found = passages_between(*((x, y, a, b) if shorter[i] else (y, x, b, a)), settings, tried)
            side = 0 if shorter[i] else 2
            # An end that stopped this close to a cut might have gone on in the whole text.
            if any((begins[i] and t[side] < near) or (mores[i] and t[side + 1] > len(a) - near) for t in tried):
                found = [(None,) * len(_SPANS)]
            else:
                move = [int(begins[i]) if c // 2 * 2 == side and c < 4 else 0 for c in range(len(_SPANS))]
                found = [tuple(v + m for v, m in zip(span, move)) for span in found]
            rows += [i] * len(found)
            spans += found
        taken = pa.array(rows, pa.int64())
        shorter_rows = batch.column("shorter").take(taken)
        goes, stays = (batch.column(c).take(taken) for c in ("goes", "stays"))
        columns = list(zip(*spans)) or [()] * len(_SPANS)
        yield pa.RecordBatch.from_arrays(
            [pc.if_else(shorter_rows, goes, stays), pc.if_else(shorter_rows, stays, goes), *(pa.array(list(c), pa.int64()) for c in columns)],
            ["doc_id", "source_id", *_SPANS])


def _hot_seeds(docs: DataFrame, settings: PassageSettings) -> DataFrame:
    """(seed, hot): seeds of more than slice_rows rows, estimated from one document in sample_of.

    They only decide where rows are sent; which seeds they are changes no result.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(settings.sample_of)) == 0)
    rows = some.mapInArrow(lambda batches: _seed_rows(batches, settings), _SEED)
    return saved(rows.groupBy("seed").count().where(F.col("count") * settings.sample_of > settings.slice_rows).select("seed", F.lit(True).alias("hot")))


def anchors(docs: DataFrame, settings: PassageSettings = PRODUCTION) -> DataFrame:
    """(doc_id, source_id, anchors, goes_on): where a document has seeds of an earlier one.

    A document's seed meets the seed's first document and the one before it, which the
    texts around the seed may differ in; the list of a pair of documents is bounded by
    the seeds of one of them. All seeds are shuffled once and scanned in the order of
    documents. A seed of very many rows is dealt over slices, each a range of documents;
    the first and last document of its slices, a row each, carry on from slice to slice.
    ``goes_on`` is false where the words around the anchors of a pair tell that none goes
    on further. Seeds of unrelated texts meet by chance, the more often the more texts there
    are; most of these pairs need no text to be told apart.
    """
    rows = docs.mapInArrow(lambda batches: _seed_rows(batches, settings), _SEED)
    hot = _hot_seeds(docs, settings)
    n_hot = hot.count()
    if n_hot:
        cuts = docs.select(F.percentile_approx("doc_id", [i / settings.slices for i in range(1, settings.slices)])).first()[0]
        number = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts or [])))), lambda c: c < F.col("doc_id")))
        slices = F.when(F.col("hot"), number).otherwise(0)
        rows = rows.join(F.broadcast(hot) if n_hot <= settings.broadcast_seeds else hot, "seed", "left").withColumn("slice", slices)
    # A constant slice would be folded, and the windows would shuffle the rows again.
    keys = ["seed", "slice"] if n_hot else ["seed"]
    group = f"over (partition by {', '.join(keys)} order by doc_id, at"
    scanned = rows.repartition(shuffle_partitions(docs.sparkSession), *keys)
    scanned = scanned.withColumn("first", F.expr(f"first_value(struct(doc_id, at, around)) {group} rows between unbounded preceding and current row)"))
    # Most seeds have one document; the other scans go without them, and without first documents.
    scanned = scanned.where("hot or first.doc_id != doc_id" if n_hot else "first.doc_id != doc_id")
    scanned = scanned.withColumn("head", F.expr(f"first_value(struct(at, around)) over (partition by {', '.join(keys)}, doc_id order by at)"))
    scanned = scanned.withColumn("behind", F.expr(f"lag(struct(doc_id, head)) {group})"))
    enters = F.when(F.col("behind.doc_id") != F.col("doc_id"), F.col("behind")).alias("enters")
    scanned = scanned.select(*keys, *(["hot"] if n_hot else []), "doc_id", "at", "around", "head", "first", enters)
    scanned = scanned.withColumn("before", F.expr(f"last_value(enters, true) {group} rows between unbounded preceding and current row)"))
    if n_hot:
        scanned = _carried(saved(scanned.drop("enters")))
    linked = scanned.where("first.doc_id != doc_id")
    # Behind the first document there is no other one before.
    before = F.when(F.col("before").isNotNull(), F.struct("before.doc_id", "before.head.*"))
    ways = F.array(F.col("first"), F.coalesce(before, F.col("first")))
    met = linked.select("doc_id", "at", "around", F.explode(F.array_distinct(ways)).alias("way"))
    goes_on = _goes_on(F.col("around"), F.col("way.around"), settings).alias("goes_on")
    met = met.select("doc_id", F.col("way.doc_id").alias("source_id"), F.struct("at", F.col("way.at").alias("source_at")).alias("anchor"), goes_on)
    return met.groupBy("doc_id", "source_id").agg(F.collect_set("anchor").alias("anchors"), F.max("goes_on").alias("goes_on"))


def _comparable(pairs: DataFrame, ids: DataFrame, settings: PassageSettings) -> DataFrame:
    """``anchors`` without the pairs that certainly have no segment: none goes on, and all lie too close together.

    A segment begins and ends at most ``slack`` words from anchors that don't go on. Where
    an id has several rows its contexts may be those of another text, so its pairs all stay.
    """
    reach = settings.min_segment - settings.seed_words - 2 * settings.slack
    spans = (F.array_max(f"anchors.{at}") - F.array_min(f"anchors.{at}") for at in ("at", "source_at"))
    kept = F.col("goes_on") | (F.least(*spans) >= reach)
    several = saved(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not several.isEmpty():
        for side in ("doc_id", "source_id"):
            marked = several.select(F.col("doc_id").alias(side), F.lit(True).alias(f"{side}_several"))
            pairs = pairs.join(broadcastable(marked, settings.broadcast_texts), side, "left")
            kept |= F.coalesce(f"{side}_several", F.lit(False))
    return pairs.where(kept).select("doc_id", "source_id", "anchors")


def _carried(scanned: DataFrame) -> DataFrame:
    """``scanned`` with the first document and the one before taken over from earlier slices."""
    ends = scanned.where("hot").groupBy("seed", "slice").agg(
        F.min(F.struct("doc_id", "at", "around")).alias("begins"), F.max(F.struct("doc_id", "head")).alias("ends"))
    order = "over (partition by seed order by slice"
    carry = ends.select(
        "seed", "slice", F.expr(f"first_value(begins) {order})").alias("whole_first"), F.expr(f"lag(ends) {order})").alias("slice_before"))
    cold = scanned.where("hot is null").drop("hot")
    moved = scanned.where("hot").drop("hot").join(carry, ["seed", "slice"]).withColumns({
        "first": F.col("whole_first"), "before": F.coalesce("before", "slice_before")}).drop("whole_first", "slice_before")
    return cold.unionByName(moved)


def _copies(docs: DataFrame, settings: PassageSettings) -> DataFrame:
    """``docs`` with first_id: the smallest id of those with the same text, null if it is the only one."""
    keyed = docs.withColumn("digest", F.unhex(F.md5("text")))
    ids = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    several = saved(ids.where("first_id != last_id").select("digest", "first_id"))
    return keyed.join(broadcastable(several, settings.broadcast_texts), "digest", "left").drop("digest")


def _aligned(pairs: DataFrame, texts: DataFrame, margin: int, settings: PassageSettings) -> DataFrame:
    """Segments (doc_id, source_id, spans) of pairs with ends; spans are null where the margin was too small.

    Of the text that goes only the words around anchors travel to the text that stays.
    """
    both = pairs.select("goes", "stays", "shorter", "anchors").join(texts.toDF("goes", "text"), "goes")
    sent = both.mapInArrow(
        lambda batches: _slice_rows(batches, margin, settings),
        "goes long, stays long, shorter boolean, anchors array<struct<at:int,source_at:int>>, words binary, begin int, more boolean")
    met = sent.join(texts.toDF("stays", "text"), "stays")
    return saved(met.mapInArrow(
        lambda batches: _passage_rows(batches, settings), "doc_id long, source_id long, " + ", ".join(f"{c} long" for c in _SPANS)))


def _segments(pairs: DataFrame, texts: DataFrame, settings: PassageSettings) -> DataFrame:
    """Distinct aligned segments of all pairs. The shorter text of a pair goes to the other one."""
    sizes = saved(texts.groupBy("doc_id").agg(F.max(F.length("text")).alias("size")))
    for side in ("doc_id", "source_id"):
        pairs = pairs.join(broadcastable(sizes.toDF(side, f"{side}_size"), settings.broadcast_texts), side)
    ends = [F.when(F.col("shorter"), F.col(a)).otherwise(F.col(b)) for a, b in (("doc_id", "source_id"), ("source_id", "doc_id"))]
    pairs = pairs.withColumn("shorter", F.col("doc_id_size") <= F.col("source_id_size")).withColumns(dict(zip(("goes", "stays"), ends)))
    done = _aligned(pairs, texts, settings.margin, settings)
    cut = done.where("start_word is null").select("doc_id", "source_id").distinct()
    if not cut.isEmpty():
        again = pairs.join(broadcastable(saved(cut), settings.broadcast_texts), ["doc_id", "source_id"], "left_semi")
        done = done.join(cut, ["doc_id", "source_id"], "left_anti").unionByName(_aligned(again, texts, 1 << 40, settings))
    return done.distinct()


def shared_passages(docs: DataFrame, settings: PassageSettings = PRODUCTION) -> DataFrame:
    """One row per segment that a document shares with an earlier one, in passages of at
    least min_words: doc_id, source_id, passage_start, passage_end, start_word, end_word,
    source_start, source_end, n_equal.

    Segments that overlap or nearly touch make a passage, as parts of one may be found in
    different earlier documents. Positions count words, ends are exclusive; words are
    compared with A-Z lowered. ``docs`` needs doc_id
    and text; other columns are ignored. Null, empty and short texts have no passages.
    Documents without an id can't be named and take no part; rows that repeat an id are
    one document, whose texts are each looked at. Repeats within one document don't
    count. Of documents with equal texts the first stands for the others, each of which is
    one passage of it. An empty table gives no rows. Texts of any length are read whole.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    docs = _copies(docs, settings)
    copies = docs.where("doc_id != first_id").select("doc_id", F.col("first_id").alias("source_id"), F.size(words(F.col("text"))).cast("long").alias("n")).distinct()
    n, zero = F.col("n"), F.lit(0).cast("long")
    copies = copies.where(n >= settings.min_words).select("doc_id", "source_id", *(c.alias(name) for c, name in zip(
        (zero, n, zero, n, zero, n, n), ("passage_start", "passage_end", *_SPANS))))
    docs = docs.where("first_id is null or doc_id = first_id").select("doc_id", "text")
    pairs = saved(_comparable(anchors(docs, settings), ids, settings))
    ids = saved(pairs.select("doc_id").union(pairs.select("source_id")).distinct())
    texts = docs.join(broadcastable(ids, settings.broadcast_texts), "doc_id", "left_semi")
    segments = saved(_segments(pairs, texts, settings))
    reach = F.expr("max(end_word) over (partition by doc_id order by start_word, end_word rows between unbounded preceding and 1 preceding)")
    fresh = (reach.isNull() | (F.col("start_word") > reach + settings.slack)).cast("int")
    number = F.expr("sum(fresh) over (partition by doc_id order by start_word, end_word rows between unbounded preceding and current row)")
    runs = segments.withColumn("fresh", fresh).withColumn("run", number)
    begin, end = (F.expr(f"{f} over (partition by doc_id, run)") for f in ("min(start_word)", "max(end_word)"))
    found = (
        runs.withColumns({"passage_start": begin, "passage_end": end})
        .where(F.col("passage_end") - F.col("passage_start") >= settings.min_words)
        .select("doc_id", "source_id", "passage_start", "passage_end", *_SPANS)
    )
    return found.unionByName(copies)
