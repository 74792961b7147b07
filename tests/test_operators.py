"""Graph, upsert, nearest, containment and burst operators against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings as hsettings, strategies as st
from pyspark.sql import functions as F

from loomgraph.operators import graph, nearest as nearest_module, snapshots, usage
from loomgraph.operators.bursts import bursts
from loomgraph.operators.containment import with_enclosing
from loomgraph.operators.nearest import _closest, _running_best, nearest
from loomgraph.operators.topk import keep_best, top_k
from loomgraph.operators.upsert import upsert
from loomgraph.session import partitions_for
from loomgraph.settings import Settings
from tests.conftest import as_set

NODE = "id string, name string, type string, created_at timestamp, updated_at timestamp"
EDGE = "from_id string, to_id string, relationship_name string, weight int, created_at timestamp, updated_at timestamp"
T1, T2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
QUICK = hsettings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def nodes(spark, *names):
    return spark.createDataFrame([(n, n, "CodeFunction", T1, T1) for n in names], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, r, 1, T1, T1) for a, b, r in rows], EDGE)


def test_node_upsert_replaces_values_and_keeps_creation(spark):
    old = spark.createDataFrame([("n1", "old_name", "CodeFunction", T1, T1)], NODE)
    new = spark.createDataFrame(
        [("n1", "mid", "CodeFunction", T2, T2), ("n1", "new_name", "CodeFunction", T2, T2)], NODE
    ).withColumn("at", F.when(F.col("name") == "mid", 0).otherwise(1))
    merged = upsert(old, new, ["id"], "at").collect()
    assert [(r.id, r.name, r.created_at, r.updated_at) for r in merged] == [("n1", "new_name", T1, T2)]


def test_upsert_is_idempotent_and_takes_empty_batches(spark):
    batch = nodes(spark, *[f"n{i}" for i in range(100)]).withColumn("at", F.lit(0))
    empty = nodes(spark).withColumn("at", F.lit(0))
    once = upsert(nodes(spark), batch, ["id"], "at")
    assert once.count() == 100
    assert as_set(upsert(once, batch, ["id"], "at"), "id", "created_at") == as_set(once, "id", "created_at")
    assert upsert(once, empty, ["id"], "at").count() == 100
    assert upsert(nodes(spark), empty, ["id"], "at").count() == 0


def test_same_edge_twice_is_one_edge(spark):
    rows = edges(spark, ("n1", "n2", "calls"))
    again = rows.withColumn("weight", F.lit(2)).withColumn("at", F.lit(1))
    merged = upsert(rows, again, ["from_id", "to_id", "relationship_name"], "at").collect()
    assert [(r.from_id, r.to_id, r.weight) for r in merged] == [("n1", "n2", 2)]


def test_neighbourhood_from_either_end(spark):
    table = edges(
        spark, ("n0", "n1", "calls"), ("n0", "n2", "calls"), ("n3", "n0", "defined_in"),
        ("n1", "n1", "calls"), ("n0", "gone", "calls"),
    )
    known = nodes(spark, "n0", "n1", "n2", "n3", "n4")
    wanted = spark.createDataFrame([("n0",), ("n1",), ("n4",)], "node_id string")
    found = [tuple(r) for r in graph.neighbours_of(table, known, wanted).collect()]
    assert sorted(found) == [
        ("n0", "n0", "calls", "n1"), ("n0", "n0", "calls", "n2"), ("n0", "n3", "defined_in", "n0"),
        ("n1", "n0", "calls", "n1"), ("n1", "n1", "calls", "n1"),
    ]
    whole = graph.neighbourhoods(table, known).filter("node_id in ('n0', 'n1')")
    assert sorted(tuple(r) for r in whole.collect()) == sorted(found)
    degree = dict(graph.degrees(table.filter("to_id <> 'gone'")).collect())
    assert degree["n0"] == 3


def test_walk_ends_in_a_cycle(spark):
    ring = edges(spark, *[(f"n{i}", f"n{(i + 1) % 5}", "calls") for i in range(5)])
    start = spark.createDataFrame([("n0",)], "node_id string")
    found = graph.reachable(ring, start, depth=12)
    assert as_set(found, "node", "depth") == {(f"n{i}", i) for i in range(5)}
    back = graph.reachable(ring, start, depth=2, reverse=True)
    assert as_set(back, "node", "depth") == {("n0", 0), ("n4", 1), ("n3", 2)}


def brute_nearest(stored, asked, k):
    out = set()
    for qid, q in asked:
        ranked = {}
        for vid, group, v in stored:
            norm = np.linalg.norm(q) * np.linalg.norm(v)
            cos = 0.0 if norm == 0 else float(np.dot(q, v) / norm)
            ranked.setdefault(group, []).append((round(1 - cos, 6) + 0.0, vid))
        for group, rows in ranked.items():
            out |= {(qid, group, vid, d) for d, vid in sorted(rows)[:k]}
    return out


@pytest.mark.parametrize("room", [64 * 1024 * 1024, 8 * 4 * 3])
def test_nearest_equals_brute_force_shipped_and_in_cells(spark, room):
    rng = random.Random(5)
    vector = lambda: [float(rng.randint(-2, 2)) for _ in range(4)]
    stored = [(f"v{i:03d}", "hot" if i % 3 else f"g{i % 4}", vector()) for i in range(200)]
    stored += [(f"w{i}", "hot", [1.0, 0.0, 0.0, 0.0]) for i in range(20)]  # exact ties
    asked = [(i, vector()) for i in range(11)] + [(11, [0.0] * 4)]
    frame = spark.createDataFrame(stored, "id string, grp string, embedding array<float>").repartition(5)
    questions = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    found = nearest(frame, questions, 7, ["grp"], settings=Settings(query_broadcast_bytes=room, embedding_dim=4))
    assert as_set(found, "query_id", "grp", "id", "distance") == brute_nearest(stored, asked, 7)


def test_top_k_in_slices_equals_plain(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 0, id % 50) k", "id * 7919 % 101 v")
    plain = as_set(top_k(rows, ["k"], [F.col("v"), F.col("id")], 5), "k", "id")
    spark.conf.set("spark.sql.shuffle.partitions", "1600")
    try:
        sliced = as_set(top_k(rows, ["k"], [F.col("v"), F.col("id")], 5, spread_on="id"), "k", "id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sliced == plain and len(plain) == 250 - 0


def test_keep_best_keeps_the_whole_row(spark):
    rows = spark.createDataFrame([(1, "b", 2.0), (1, "a", 1.0), (2, "c", 3.0)], "k int, n string, d double")
    assert as_set(keep_best(rows, ["k"], [F.col("d"), F.col("n")]), "k", "n", "d") == {(1, "a", 1.0), (2, "c", 3.0)}


@st.composite
def nested_spans(draw):
    """Properly nested line ranges with distinct starts."""
    spans, stack = [], [(0, draw(st.integers(5, 60)))]
    while stack:
        low, high = stack.pop()
        at = low
        while at < high and draw(st.booleans()):
            start = draw(st.integers(at, high - 1))
            end = draw(st.integers(start, high - 1))
            spans.append((start, end))
            if end > start + 1:
                stack.append((start + 1, end))
            at = end + 1
    return sorted(set(spans))


@QUICK
@given(spans=nested_spans(), points=st.lists(st.integers(0, 60), min_size=1, max_size=20))
def test_enclosing_equals_brute_force(spark, spans, points):
    rows = [("f", i, s, e, True) for i, (s, e) in enumerate(spans)]
    rows += [("f", 1000 + i, p, None, False) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "file string, id int, s int, e int, span boolean")
    for outermost in (False, True):
        found = with_enclosing(frame, ["file"], "s", "e", F.col("span"), ["id"], ["id"], "o", outermost)
        got = {r.id: r.o.id if r.o else None for r in found.filter("not span").collect()}
        for i, p in enumerate(points):
            around = [(e - s, j) for j, (s, e) in enumerate(spans) if s <= p <= e]
            want = (max(around) if outermost else min(around))[1] if around else None
            assert got[1000 + i] == want


@QUICK
@given(
    seconds=st.lists(st.tuples(st.sampled_from(["hot", "hot", "cold"]), st.integers(0, 400)), min_size=1, max_size=60),
    gap=st.sampled_from([2, 4]),
)
def test_bursts_equal_brute_force(spark, seconds, gap):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(seconds=s)) for k, s in seconds]
    frame = spark.createDataFrame(rows, "repo string, ts timestamp")
    found = as_set(bursts(frame, "repo", "ts", gap, chunk_seconds=20), "repo", "burst", "first_ts", "last_ts", "changes")
    want = set()
    for key in {k for k, _ in rows}:
        times, number = sorted(t for k, t in rows if k == key), 0
        group = [times[0]]
        for t in times[1:] + [None]:
            if t is not None and (t - group[-1]).total_seconds() <= gap:
                group.append(t)
                continue
            number += 1
            want.add((key, number, group[0], group[-1], len(group)))
            group = [t]
    assert found == want


def test_gap_of_exactly_two_seconds_joins(spark):
    base = dt.datetime(2024, 1, 1)
    offsets = [0, 1, 3, 5.001]
    frame = spark.createDataFrame([("r", base + dt.timedelta(seconds=s)) for s in offsets], "repo string, ts timestamp")
    assert [r.changes for r in bursts(frame, "repo", "ts", 2).orderBy("burst").collect()] == [3, 1]


@QUICK
@given(
    current=st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 2), max_size=8),
    stored=st.dictionaries(st.sampled_from("abcdefgh"), st.integers(0, 2), max_size=8),
)
def test_diff_partitions_the_paths(spark, current, stored):
    ddl = "repo_id string, file_path string, content_hash string"
    frame = lambda d: spark.createDataFrame([("r", p, str(h)) for p, h in d.items()], ddl)
    found = {r.file_path: r.status for r in snapshots.diff(frame(current), frame(stored)).collect()}
    assert set(found) == set(current) | set(stored)
    for path, status in found.items():
        want = (
            "new" if path not in stored else "deleted" if path not in current
            else "unchanged" if current[path] == stored[path] else "changed"
        )
        assert status == want


def test_usage_formula_and_recorded_days(spark):
    day = lambda n: dt.datetime(2024, 3, n, 12)
    rows = [("search_code", day(n), 400, 10) for n in (1, 3, 5, 6, 9, 11, 14, 20, 21)]
    rows += [("advise", day(21), 3, 0), ("unknown", day(21), 8000, 9), ("find_symbol", day(21), 40000, 1)]
    calls = spark.createDataFrame(rows, "tool string, ts timestamp, response_len bigint, result_count bigint")
    per_tool = {(str(r.day), r.tool): r for r in usage.by_tool(calls).collect()}
    hit = per_tool[("2024-03-21", "search_code")]
    assert (hit.tokens, hit.traditional, hit.saved) == (100, 6900, 6800)
    assert per_tool[("2024-03-21", "advise")].tokens == 1
    assert per_tool[("2024-03-21", "unknown")].saved == 0
    assert per_tool[("2024-03-21", "find_symbol")].saved == 0  # never negative
    total = usage.summary(calls, 7).first()
    assert (total.days, total.total_calls, total.lifetime_calls) == (7, 10, 12)
    assert [str(r.day)[-2:] for r in usage.last_days(calls, 7).collect()] == ["21", "20", "14", "11", "09", "06", "05"]
    assert usage.summary(calls.limit(0)).first().overall_pct == 0.0


def test_copies_count_once_before_the_cut(spark):
    rows = [(f"c{i:02d}", 1, [1.0, 0.0]) for i in range(50)] + [(f"d{i}", 10 + i, [1.0, float(i + 1)]) for i in range(6)]
    frame = spark.createDataFrame(rows, "id string, copy bigint, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<float>")
    for room in (64 * 1024 * 1024, 1):
        found = nearest(frame, asked, 4, copies="copy", settings=Settings(query_broadcast_bytes=room, embedding_dim=2))
        assert [r.id for r in found.orderBy("distance").collect()] == ["c00", "d0", "d1", "d2"]


def test_name_matrix_agrees_with_the_columns(spark):
    import pandas as pd

    from loomgraph.operators.names import kind_matches, match_matrix, name_matches

    stored = [("Parse", "function"), ("parse_all", "const"), ("", "class"), (None, None), ("x", "arrow"), ("Ünit", "type_alias")]
    asked = [("parse", None), ("PARSE_ALL_NOW", "variable"), ("", "function"), ("x", "type"), (None, None), ("ünit", "Type")]
    got = match_matrix(*(pd.Series(c) for c in zip(*stored)), *(pd.Series(c, dtype=object) for c in zip(*asked)))
    left = spark.createDataFrame([(i, *s) for i, s in enumerate(stored)], "i int, name string, kind string")
    right = spark.createDataFrame([(j, *a) for j, a in enumerate(asked)], "j int, wanted string, want_kind string")
    hit = name_matches(F.col("name"), F.col("wanted")) & kind_matches(F.col("kind"), F.col("want_kind"))
    for r in left.crossJoin(right).select("i", "j", F.coalesce(hit, F.lit(False)).alias("hit")).collect():
        assert bool(got[r.i, r.j]) == r.hit, (stored[r.i], asked[r.j])


@pytest.mark.parametrize("width, copies", [(300, False), (300, True), (5, True), (300, "few")])
def test_closest_equals_full_sort(width, copies):
    rng = np.random.default_rng(7)
    distance = np.round(rng.random((9, width)), 2)  # many ties
    codes = None
    if copies:
        codes = rng.integers(0, 3 if copies == "few" else 12, width)
    got = [[] for _ in distance]
    for j, at, d in zip(*_closest(distance.copy(), 4, codes)):
        got[j].append((d, at))
    for j, row in enumerate(distance):
        want, seen = [], set()
        for d, at in sorted((d, at) for at, d in enumerate(row)):
            if codes is None or codes[at] not in seen:
                want.append((d, at))
                seen.add(None if codes is None else codes[at])
        assert got[j] == want[:4]


def test_a_task_sends_k_candidates_however_many_batches_it_reads(monkeypatch):
    monkeypatch.setattr(nearest_module, "_HELD_ROWS", 100)
    parts = [pd.DataFrame({"query_id": [1] * 30, "id": range(i, i + 30), "distance": 0.5}) for i in range(0, 900, 30)]
    sent = pd.concat(_running_best(iter(parts), [], 10, None))
    assert sent["id"].tolist() == list(range(10))


def test_cells_do_not_share_tasks_by_size(spark, monkeypatch):
    monkeypatch.setattr(nearest_module, "_CELL_ROWS", 10)
    frame = spark.range(60).selectExpr("id", "array(float(id), 1f) embedding")
    found = nearest(frame, frame.withColumnRenamed("id", "query_id"), 3, settings=Settings(query_broadcast_bytes=160, embedding_dim=2))
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert partitions_for(spark.range(10), 2) == max(5, cores)
    assert [partitions_for(spark.range(n), 10) for n in (0, 1000, 6001)] == [cores, 100, 601]
