"""Vector codes against brute force with whole numbers of any size."""

import math
import random

import numpy as np
import pytest

from loomgraph.llm.codes import CodeSettings, metric_tree, squares, vector_codes, walk, _entries_of

SCHEMA = "vec_id long, embedding array<double>, label int, code int, error string, of int"


def brute(rows, k=16, parts=8, rounds=6):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next(len(r[1]) for r in kept if r[1] and len(r[1]) % parts == 0)
    same = [r for r in kept if len(r[1]) == width]
    step = width // parts

    def whole(x):
        top, bottom = float(x).as_integer_ratio()
        return top * 4096 // bottom

    vectors = [[[whole(x) for x in r[1][p * step : (p + 1) * step]] for p in range(parts)] for r in same]
    books = [[v[p] for v in vectors[:k]] for p in range(parts)]

    def best(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            owned = {}
            for v in vectors:
                owned.setdefault(best(v[p], books[p])[1], []).append(v[p])
            books[p] = [[sum(c) // len(owned[i]) for c in zip(*owned[i])] if i in owned else e for i, e in enumerate(books[p])]
    out = [(r[0], None, None) for r in kept if len(r[1]) != width]
    for r, v in zip(same, vectors):
        found = [best(v[p], books[p]) for p in range(parts)]
        error = sum(f[0] for f in found)
        out.append((r[0], "".join(f"{f[1]:02x}" for f in found), error if error < 2**63 else None))
    return sorted(out, key=repr)


def rows_of(rng, n, width, spread=1.0):
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(5)]
    return [(i * 3, [c + rng.gauss(0, spread / 8) for c in rng.choice(centres)], rng.choice([None, 0, 1])) for i in range(n)]


def result(spark, rows, settings=CodeSettings(leaf_points=4, block_numbers=16 * 60)):
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(((r.vec_id, r.code, r.error) for r in vector_codes(frame, settings).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_codes_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = rows_of(rng, 400, 16)
    rows += [(i, v, 2) for i, v, _ in rows[:40]]  # repeated rows and ids
    rows += [(1, None, 1), (4, [None] * 16, 1), (7, [float("nan")] * 16, 1), (10, [float("-inf")] * 16, 1), (None, [0.25] * 16, None), (13, [], 1), (16, [0.5] * 24, 0)]
    assert result(spark, rows) == brute(rows)


def test_vectors_of_any_size_and_few_vectors(spark):
    rng = random.Random(7)
    rows = rows_of(rng, 60, 8) + [(1000 + i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([3, 9, 30, 300]) for _ in range(8)], 0) for i in range(12)]
    assert result(spark, rows) == brute(rows)
    assert result(spark, rows[:5]) == brute(rows[:5])
    assert result(spark, [(1, [1.0] * 8, 0)] * 3) == brute([(1, [1.0] * 8, 0)] * 3)
    assert result(spark, []) == [] and result(spark, [(1, [], 0), (2, None, 0)]) == [(1, None, None)]


def test_balls_are_owned_whole():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    tree = metric_tree(points, 32)
    for a, b, p, r, s in zip(tree.start, tree.end, tree.pivot, tree.radius, tree.sums):
        assert (squares(tree.points[a:b], p) <= r * r * (1 + 1e-9)).all() and (tree.points[a:b].sum(axis=0) == s).all()
    looked = sum(len(places) for places, _, far in walk(tree, centres) if far is not None)
    assert looked < len(points) / 4
    entry, error = _entries_of(tree, centres)
    far = ((points[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (entry == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


def test_label_errors(spark):
    rows = [(*r, 1, "x", 2) for r in rows_of(random.Random(2), 100, 8)]
    got = vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    label = {r[0]: r[2] for r in rows}
    total = {}
    for r in got:
        total[label[r.vec_id]] = total.get(label[r.vec_id], 0) + r.error
    assert all(r.label_error == total[label[r.vec_id]] for r in got)
