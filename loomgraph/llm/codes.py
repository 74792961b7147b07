"""Vectors as codes of part entries, learnt exactly by metric trees over the parts.

Every block of vectors gets, per part, a tree of balls: anchors are found among the block's
points (each new anchor is the point farthest from its own, and takes what is nearer to it),
neighbouring anchors are merged upward into larger balls, and each anchor's ball is divided
downward in the same way. A ball caches its points' sum and count.

A round sends the codebook, 16 entries a part, to all blocks. A ball inherits the entries that
could still own one of its points; an entry goes once another is nearer everywhere in the
ball. When one is left the ball is owned whole, and its cached sum and count are added without
looking at a point. Points of leaves meet the entries left. All distances and sums are whole
numbers; only the test that drops an entry uses floats, rounded against dropping.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomgraph.llm.common import broadcastable, saved


@dataclass(frozen=True)
class CodeSettings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    leaf_points: int = 32
    block_numbers: int = 1 << 19  # components of a block's vectors
    broadcast_labels: int = 100_000


PRODUCTION = CodeSettings()

#: Below this, squared distances of whole vectors of 2^14 components stay within 64 bits.
_SMALL = 1 << 23


@dataclass
class Tree:
    """Balls in arrays, parents before children; ball i holds points[start[i]:end[i]]."""

    points: np.ndarray  # of one part, in the tree's order
    order: np.ndarray  # place of each point in the block
    pivot: np.ndarray
    radius: np.ndarray  # rounded up
    sums: np.ndarray
    start: np.ndarray
    end: np.ndarray
    children: list[list[int]]


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    gap = points - centre
    return (gap * gap).sum(axis=-1)


def _root_up(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + 1e-12)


def anchors(points: np.ndarray, rows: np.ndarray, wanted: int) -> list[tuple[int, np.ndarray]]:
    """(anchor, its rows), at most ``wanted``: each new anchor is the farthest owned point."""
    first = int(rows[0])
    owned = [(first, rows, squares(points[rows], points[first]))]
    while len(owned) < wanted:
        at = max(range(len(owned)), key=lambda i: owned[i][2].max())
        _, members, far = owned[at]
        if not far.max():
            break  # all points equal their anchor
        new = int(members[int(far.argmax())])
        taken, kept = [], []
        for anchor, members, far in owned:
            # A point nearer to its anchor than half the anchors' distance can't change.
            apart = int(squares(points[new], points[anchor]))
            open_ = 4 * far >= apart
            if open_.any():
                some = np.flatnonzero(open_)
                to_new = squares(points[members[some]], points[new])
                moves = to_new < far[some]
                if moves.any():
                    taken.append((members[some[moves]], to_new[moves]))
                    stay = np.ones(len(members), bool)
                    stay[some[moves]] = False
                    members, far = members[stay], far[stay]
            kept.append((anchor, members, far))
        owned = [*kept, (new, np.concatenate([t[0] for t in taken]), np.concatenate([t[1] for t in taken]))]
    return [(a, m) for a, m, _ in owned]


def _merged(points: np.ndarray, balls: list) -> object:
    """Balls under one root, the two whose common ball is smallest first."""
    nodes = {i: b for i, b in enumerate(balls)}
    spread = {i: (points[b[0]], float(np.sqrt(float(squares(points[b[1]], points[b[0]]).max()))), len(b[1])) for i, b in nodes.items()}

    def size(i, j):
        return (float(np.sqrt(float(squares(spread[i][0], spread[j][0])))) + spread[i][1] + spread[j][1]) / 2

    queue = [(size(i, j), i, j) for i in nodes for j in nodes if i < j]
    heapq.heapify(queue)
    while len(nodes) > 1:
        radius, i, j = heapq.heappop(queue)
        if i in nodes and j in nodes:
            a, b, n = nodes.pop(i), nodes.pop(j), len(spread)
            larger = i if spread[i][2] >= spread[j][2] else j
            spread[n] = (spread[larger][0], radius, spread[i][2] + spread[j][2])
            for k in nodes:
                heapq.heappush(queue, (size(k, n), k, n))
            nodes[n] = [a, b]
    return next(iter(nodes.values()))


def _shape(points: np.ndarray, rows: np.ndarray, leaf: int) -> object:
    """A ball as nested lists of balls, leaves as arrays of rows."""
    if len(rows) <= leaf:
        return rows
    found = anchors(points, rows, max(2, int(len(rows) ** 0.5)))
    if len(found) == 1:
        return rows
    grown = _merged(points, found)

    def down(ball):
        if isinstance(ball, list):
            return [down(b) for b in ball]
        return _shape(points, ball[1], leaf)

    return down(grown)


def metric_tree(points: np.ndarray, leaf: int) -> Tree:
    """The tree of a part's points; points of unbounded size make one leaf."""
    rows = np.arange(len(points))
    shape = rows if points.dtype == object else _shape(points, rows, leaf)
    order, balls, children = [], [], []

    waiting = [(shape, -1)]
    spans: list[list[int]] = []
    while waiting:
        ball, parent = waiting.pop()
        number = len(balls)
        balls.append(ball)
        children.append([])
        spans.append([sum(map(len, order)), 0])
        if parent >= 0:
            children[parent].append(number)
        if isinstance(ball, list):
            waiting.extend((b, number) for b in reversed(ball))
        else:
            order.append(ball)
    total = len(points)
    for i in range(len(balls) - 1, -1, -1):
        spans[i][1] = spans[i][0] + len(balls[i]) if not children[i] else spans[children[i][-1]][1]
    order = np.concatenate(order) if total else rows
    inside = points[order]
    start, end = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    sums = np.stack([inside[a:b].sum(axis=0) for a, b in spans])
    pivot, radius = np.zeros((len(balls), points.shape[1]), points.dtype), np.zeros(len(balls))
    if points.dtype != object:
        pivot = sums // np.maximum(end - start, 1)[:, None]
        radius = np.array([_root_up(squares(inside[a:b], p).max(initial=0)) for (a, b), p in zip(spans, pivot)])
    return Tree(inside, order, pivot, radius, sums, start, end, children)


def walk(tree: Tree, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(balls, their entry) owned whole, then (points' places in the tree, entry, -) of leaves."""
    exact = tree.points.dtype != object and book.dtype != object
    _, first = np.unique([tuple(e) for e in book.tolist()], axis=0, return_index=True) if exact and book.shape[1] else (None, np.array([0]))
    left = np.zeros((1, len(book)), bool)
    left[0, first] = True
    if not exact:
        left[:] = True
    balls = np.array([0])
    apart = np.sqrt(((book[:, None] - book[None]) ** 2).sum(axis=2).astype(np.float64)) * (1 + 1e-9) if exact else None
    while len(balls):
        if exact:
            far = ((tree.pivot[balls][:, None] - book[None]) ** 2).sum(axis=2)
            far = np.where(left, far, np.iinfo(np.int64).max)
            best = far.argmin(axis=1)
            lead = np.take_along_axis(far, best[:, None], 1)
            # Over a ball the difference of two squared distances falls by twice the radius
            # times the entries' distance at most.
            gap = np.where(left, far - lead, 0).astype(np.float64)
            left = left & ~(gap > 2 * tree.radius[balls][:, None] * apart[best] * (1 + 1e-9) + 1)
            whole = left.sum(axis=1) == 1
        else:
            whole = np.zeros(len(balls), bool)
        yield balls[whole], left[whole].argmax(axis=1), None
        balls, left = balls[~whole], left[~whole]
        leaf = np.array([not tree.children[b] for b in balls], bool)
        if leaf.any():
            spans = [np.arange(tree.start[b], tree.end[b]) for b in balls[leaf]]
            places, masks = np.concatenate(spans), np.repeat(left[leaf], [len(s) for s in spans], axis=0)
            yield places, *nearest(tree.points[places], book, masks)
        inner = [(c, i) for i in np.flatnonzero(~leaf) for c in tree.children[balls[i]]]
        balls = np.array([c for c, _ in inner], np.int64)
        left = left[[i for _, i in inner]] if inner else left[:0]


def nearest(points: np.ndarray, book: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point, among its entries left; the lower entry of ties."""
    best = np.full(len(points), -1)
    error = np.zeros(len(points), points.dtype if points.dtype == object else book.dtype)
    for e in range(len(book)):
        at = np.flatnonzero(masks[:, e])
        far = squares(points[at], book[e])
        better = (best[at] < 0) | (far < error[at])
        best[at[better]], error[at[better]] = e, far[better]
    return best, error


def _entries_of(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of every point, in the block's order."""
    entry, error = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), object if tree.points.dtype == object or book.dtype == object else np.int64)
    for places, found, far in walk(tree, book):
        if far is None:
            for ball, e in zip(places, found):
                a, b = tree.start[ball], tree.end[ball]
                entry[a:b], error[a:b] = e, squares(tree.points[a:b], book[e])
        else:
            entry[places], error[places] = found, far
    back = np.empty(len(entry), np.int64)
    back[tree.order] = np.arange(len(entry))
    return entry[back], error[back]


def _added(tree: Tree, book: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """(entry, count, sums) of what the tree's points give to each entry."""
    sums = [np.zeros(book.shape[1], object) for _ in book]
    counts = [0] * len(book)
    for places, found, far in walk(tree, book):
        for e in np.unique(found):
            some = places[found == e]
            if far is None:
                counts[e] += int((tree.end[some] - tree.start[some]).sum())
                sums[e] = sums[e] + tree.sums[some].sum(axis=0).astype(object)
            else:
                counts[e] += len(some)
                sums[e] = sums[e] + tree.points[some].sum(axis=0).astype(object)
    return ((e, n, [int(v) for v in s]) for e, (n, s) in enumerate(zip(counts, sums)) if n)


def whole_numbers(rows: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one width, as 64-bit numbers where small, else of any size."""
    if not rows:
        return np.zeros((0, 0), np.int64)
    values = np.stack(rows).astype(np.float64)
    if not values.size or np.abs(values).max() * scale < _SMALL:
        return np.floor(values * scale).astype(np.int64)
    # Beyond 2^53 a float is a whole number itself.
    exact = [[int(x) * scale if abs(x) > 2.0**53 else int(np.floor(x * scale)) if abs(x) * scale < 2.0**53 else _floor(x, scale) for x in row] for row in values.tolist()]
    out = np.empty(values.shape, object)
    out[:] = exact
    return out


def _floor(x: float, scale: int) -> int:
    top, bottom = float(x).as_integer_ratio()
    return top * scale // bottom


_BLOCK = "vec_ids array<long>, labels array<string>, tree binary"


def _blocks(batches: Iterator[pa.RecordBatch], width: int, settings: CodeSettings) -> Iterator[pa.RecordBatch]:
    most = max(1, settings.block_numbers // max(width, 1))

    def built(ids, labels, rows):
        numbers, step = whole_numbers(rows, settings.scale), width // settings.parts
        trees = [vars(metric_tree(numbers[:, p * step : (p + 1) * step], settings.leaf_points)) for p in range(settings.parts)]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([labels], pa.list_(pa.string())), pa.array([pickle.dumps(trees, 5)], pa.binary())],
            ["vec_ids", "labels", "tree"])

    ids, labels, rows = [], [], []
    for batch in batches:
        for i, label, vector in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding")):
            ids.append(i)
            labels.append(label)
            rows.append(vector.values.to_numpy(zero_copy_only=False))
            if len(rows) >= most:
                yield built(ids, labels, rows)
                ids, labels, rows = [], [], []
    if rows:
        yield built(ids, labels, rows)


def _trees(stored: pa.Scalar) -> list[Tree]:
    return [Tree(**fields) for fields in pickle.loads(stored.as_py())]


def _rounds(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(part, entry, position, limb, value): counts at position -1; sums in limbs of 40 bits."""
    for batch in batches:
        rows = []
        for tree in batch.column("tree"):
            for p, (one, book) in enumerate(zip(_trees(tree), books)):
                for e, n, sums in _added(one, book):
                    for at, value in enumerate([n, *sums], -1):
                        limb = 0
                        while True:
                            low = value if -(1 << 40) < value < 1 << 40 else value & ((1 << 40) - 1)
                            rows.append((p, e, at, limb, low))
                            value, limb = (value - low) >> 40, limb + 1
                            if not value:
                                break
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["part", "entry", "at", "limb", "value"])


def _coded(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    digits = np.array([f"{e:02x}" for e in range(max(map(len, books)))])
    for batch in batches:
        for ids, labels, tree in zip(batch.column("vec_ids"), batch.column("labels"), batch.column("tree")):
            codes, total = np.full(len(ids), "", object), 0
            for one, book in zip(_trees(tree), books):
                entry, error = _entries_of(one, book)
                codes, total = codes + digits[entry].astype(object), total + error
            errors = [int(v) if v < 1 << 63 else None for v in total.tolist()]
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(codes.tolist(), pa.string()), pa.array(errors, pa.int64()), labels.values],
                                             ["vec_id", "code", "error", "label"])


def _book(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(v) < _SMALL for r in rows for v in r)
    out = np.empty((len(rows), len(rows[0]) if rows else 0), np.int64 if small else object)
    out[:] = rows
    return out


def learn_codebooks(blocks: DataFrame, books: list[list[list[int]]], settings: CodeSettings = PRODUCTION) -> list[list[list[int]]]:
    """The codebooks after the rounds; per round the driver gets one row per part, entry and component."""
    for _ in range(settings.rounds):
        sent = [_book(b) for b in books]
        added = blocks.select("tree").mapInArrow(lambda batches, sent=sent: _rounds(batches, sent), "part long, entry long, at long, limb long, value long")
        totals: dict[tuple[int, int, int], int] = {}
        for r in added.groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect():
            place = (r["part"], r["entry"], r["at"])
            totals[place] = totals.get(place, 0) + (r["value"] << (40 * r["limb"]))
        books = [
            [[totals[p, e, at] // totals[p, e, -1] for at in range(len(entry))] if (p, e, -1) in totals else entry for e, entry in enumerate(book)]
            for p, book in enumerate(books)]
    return books


def vector_codes(vectors: DataFrame, settings: CodeSettings = PRODUCTION) -> DataFrame:
    """One row per kept row of ``vectors``: vec_id, code, error, label_error, codebooks_sha256.

    Rows whose embedding is null, or holds null or non-finite components, are dropped.
    Components become floor(scale * x). The width is that of the first kept row by vec_id
    (nulls last; repeated ids by vector) that divides into the parts; rows of another width,
    empty vectors with them, can't be cut and come back with null code and error. Errors
    beyond 64 bits are null too. Repeated rows each count and each come back; equal distances
    go to the lower entry; null labels are one label. Other columns are ignored. An empty table
    gives no rows. Fewer than 16 vectors make a codebook of as many entries.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False)))
    width = F.size("embedding")
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    cut = kept.where((width > 0) & (width % settings.parts == 0))
    head = cut.orderBy(*order).limit(1).select(width.alias("w")).first()
    wide = head["w"] if head else 0
    same = kept.where((width == wide) & (width > 0))
    first = [np.array(r["embedding"], np.float64) for r in same.orderBy(*order).limit(settings.entries).select("embedding").collect()]
    numbers, step = whole_numbers(first, settings.scale).tolist(), wide // settings.parts
    books = [[row[p * step : (p + 1) * step] for row in numbers] for p in range(settings.parts)]
    if numbers:
        blocks = saved(same.mapInArrow(lambda batches: _blocks(batches, wide, settings), _BLOCK))
        books = learn_codebooks(blocks, books, settings)
        sent = [_book(b) for b in books]
        coded = blocks.mapInArrow(lambda batches: _coded(batches, sent), "vec_id long, code string, error long, label string")
    else:
        coded = kept.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), "label")
    others = kept.where((width != wide) | (width == 0)).select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "label")
    coded = saved(coded.unionByName(others))
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error"))
    sums = saved(sums.withColumn("label_error", F.expr("try_cast(label_error as bigint)")))
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return coded.join(broadcastable(sums, settings.broadcast_labels), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def codes_sql(settings: CodeSettings = PRODUCTION) -> str:
    """The same result, without trees, as SQL over embeddings."""
    k, p = settings.entries, settings.parts
    steps = [f"""
        n as (select row_number() over (order by vec_id nulls last, embedding) r, vec_id, label, embedding v from embeddings
              where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        w as (select len(v) // {p} s from n limit 1),
        x as (select r, (i - 1) // s part, (i - 1) % s pos, floor({settings.scale} * v[i]::double)::bigint c
              from (select r, v, s, unnest(range(1, s * {p} + 1)) i from n, w)),
        b0 as (select part, r - 1 entry, pos, c from x where r <= {k})"""]
    for t in range(settings.rounds + 1):
        steps.append(f"""
        d{t} as (select x.r, x.part, b.entry, sum((x.c - b.c) * (x.c - b.c))::hugeint far from x join b{t} b using (part, pos) group by all),
        a{t} as (select r, part, m % {k} entry, m // {k} far from (select r, part, min(far * {k} + entry) m from d{t} group by r, part))""")
        if t < settings.rounds:
            steps.append(f"""
        m{t} as (select part, entry, pos, sum(c)::hugeint s, count(*) n from x join a{t} using (r, part) group by all),
        b{t + 1} as (select part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, c)::bigint c from b{t} left join m{t} using (part, entry, pos))""")
    end = settings.rounds
    return f"""
        with {','.join(steps)},
        h as (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) codebooks_sha256 from b{end}),
        e as (select r, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' order by part) code, sum(far)::bigint error from a{end} group by r)
        select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256
        from n join e using (r), h
    """
