"""Repeated line runs against brute force."""

import random

import pytest

from loomgraph.llm.lines import LineSettings, line_dedup, ranked_pairs
from pyspark.sql import functions as F


def brute(texts, least):
    lines = [[(i, line) for i, line in enumerate(t.split("\n")) if line.strip()] for t in texts]
    gone, first = [set() for _ in texts], {}
    for d, own in enumerate(lines):
        for n in range(len(own) - least + 1):
            run = tuple(line for _, line in own[n : n + least])
            if run in first:
                gone[d].update(own[k][0] for k in range(n, n + least))
            first.setdefault(run, (d, n))
    out = []
    for d, (own, text) in enumerate(zip(lines, texts)):
        longest = 0
        for n in range(len(own)):
            for e, other in enumerate(lines):
                for m in range(len(other)):
                    k = 0
                    if (d, n) != (e, m):
                        while n + k < len(own) and m + k < len(other) and own[n + k][1] == other[m + k][1]:
                            k += 1
                    longest = max(longest, k)
        kept = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone[d])
        out.append((d, kept, len(text.split("\n")), len(gone[d]), longest))
    return out


@pytest.mark.parametrize("least", [1, 2])
def test_line_dedup_matches_brute_force(make_docs, least):
    rng = random.Random(least)
    texts = ["\n".join(rng.choice(["a b", "c", "d e f", "", " ", f"own {rng.randrange(40)}"]) for _ in range(rng.randint(0, 12))) for _ in range(25)]
    texts += texts[:6] + ["\n\n" + texts[2] + "\n ", "x y\n" * 9, "x y\n" * 9, "once", "once"]
    rows = line_dedup(make_docs(texts), LineSettings(min_lines=least)).collect()
    assert sorted(tuple(r) for r in rows) == brute(texts, least)


def test_ranks_carry_over_ranges(spark):
    rng = random.Random(4)
    # One class fills many ranges.
    keys = sorted({(rng.choice([1, 5, 5, 5, 5, 9]), rng.choice([0, 7]), rng.randrange(60), rng.choice([None, 3])) for _ in range(600)}, key=lambda k: (k[0], k[1], k[2], k[3] is not None, k[3] or 0))
    rows = [(*k, rng.randint(1, 4)) for k in keys]
    frame = spark.createDataFrame(rows, "line long, sub long, next_line long, next_sub long, members long").withColumn("first", F.lit(1))
    want, start, total = {}, {}, 0
    for number, (line, sub, a, b, members) in enumerate(rows):
        start.setdefault((line, sub), total)
        want[line, sub, a, b] = (number, sub + total - start[line, sub])
        total += members
    assert {(r.line, r.sub, r.next_line, r.next_sub): (r.number, r.new_sub) for r in ranked_pairs(frame).collect()} == want
