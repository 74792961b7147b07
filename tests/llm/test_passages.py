"""Seeds' partners against brute force, with and without slices; copies of whole texts."""

from __future__ import annotations

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm.hashing import word_hashes
from loomgraph.llm.passages import PRODUCTION, anchors, minimizers, shared_passages


def _texts(rng: random.Random, n: int) -> list[str]:
    common = [" ".join(f"c{rng.randrange(500)}" for _ in range(30)) for _ in range(3)]
    return [" ".join([*(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))), *rng.sample(common, rng.randrange(3)) * rng.choice([1, 1, 2])]) for _ in range(n)]


@pytest.mark.parametrize("settings", [
    PRODUCTION, replace(PRODUCTION, slice_rows=8, slices=5, sample_of=1), replace(PRODUCTION, slice_rows=0, slices=7, sample_of=1, broadcast_seeds=0)])
def test_seeds_meet_the_first_document_and_the_one_before(make_docs, settings):
    texts = _texts(random.Random(21), 60)
    places: dict[int, list[tuple[int, int]]] = {}
    for doc, (_, hashes) in enumerate(word_hashes(pa.array(texts), lower=True)):
        for seed, at in zip(*minimizers(hashes, settings)):
            places.setdefault(int(seed), []).append((doc, int(at)))
    brute = set()
    for rows in places.values():
        rows.sort()
        heads = {}
        for doc, at in rows:
            heads.setdefault(doc, at)
        order = list(heads)
        for doc, at in rows:
            if doc != order[0]:
                for other in (order[0], order[order.index(doc) - 1]):
                    brute.add((doc, other, at, heads[other]))
    found = anchors(make_docs(texts).select("doc_id", "text"), settings).collect()
    assert len({(r.doc_id, r.source_id) for r in found}) == len(found)
    assert {(r.doc_id, r.source_id, a.at, a.source_at) for r in found for a in r.anchors} == brute


def test_copies_are_whole_passages_of_the_first(make_docs):
    rng = random.Random(22)
    long, short = (" ".join(f"w{rng.randrange(9999)}" for _ in range(n)) for n in (80, 49))
    rows = shared_passages(make_docs([short, long, short, long, "x y " + long, long, "", "", None])).collect()
    whole = {(r.doc_id, r.source_id, r.passage_start, r.passage_end, r.start_word, r.end_word, r.source_start, r.source_end, r.n_equal) for r in rows}
    assert whole == {(d, 1, 0, 80, 0, 80, 0, 80, 80) for d in (3, 5)} | {(4, 1, 2, 82, 2, 82, 0, 80, 80)}


def test_any_margin_gives_the_same_segments(make_docs):
    rng = random.Random(23)
    texts = [[f"w{rng.randrange(9999)}" for _ in range(rng.choice([90, 150, 400]))] for _ in range(20)]
    for i in range(10):
        n = rng.choice([30, 60, 80])
        passage = [w if (j + i) % (9 + 4 * i) else "new" for j, w in enumerate(texts[i][5 : 5 + n])]
        texts[10 + i][7 : 7 + n] = passage
    docs = make_docs([" ".join(t) for t in texts])
    rows = [sorted(map(tuple, shared_passages(docs, replace(PRODUCTION, margin=m)).collect())) for m in (0, 9, PRODUCTION.margin, 1 << 40)]
    assert len(rows[0]) >= 6 and all(r == rows[0] for r in rows)


def test_lone_seeds_are_settled_together_and_alike(monkeypatch):
    """Pairs with one seed go through the batch's common look unless it could matter, with equal segments."""
    from loomgraph.llm import passages

    rng = random.Random(24)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for n in range(400):
        a, b = ([rng.choice(words) for _ in range(rng.choice([5, 9, 40, 90]))] for _ in range(2))
        i, j = rng.randrange(len(a) - 4), rng.randrange(len(b) - 4)
        run = rng.choice([5, 5, 5, 20, 23, 24, 30])
        a[i : i + run] = b[j : j + run] = [f"s{n}.{t}" for t in range(run)]
        if n % 3:  # further words behind a difference
            tail = [f"t{t}" for t in range(rng.choice([3, 4, 30]))]
            a, b = a[: i + run] + ["x"] + tail, b[: j + run] + ["y", "z"][: n % 3] + tail
        anchors_ = [{"at": i, "source_at": j}] + ([{"at": i + 1, "source_at": j + 1}] if n % 7 == 0 and run > 5 else [])
        cut = rng.choice([0, 0, max(0, i - 5)])
        end = rng.choice([len(a), min(len(a), i + run + 8)])
        hashes = next(iter(word_hashes(pa.array([" ".join(a)]), lower=True)))[1]
        rows.append({"goes": n, "stays": -n, "shorter": n % 2 == 0, "anchors": anchors_ if n % 2 == 0 else [{"at": x["source_at"], "source_at": x["at"]} for x in anchors_],
                     "words": hashes[cut:end].tobytes(), "begin": cut, "more": end < len(a), "text": " ".join(b)})
    anchor = pa.struct([("at", pa.int32()), ("source_at", pa.int32())])
    schema = pa.schema([("goes", pa.int64()), ("stays", pa.int64()), ("shorter", pa.bool_()), ("anchors", pa.list_(anchor)),
                        ("words", pa.binary()), ("begin", pa.int32()), ("more", pa.bool_()), ("text", pa.string())])
    batch = pa.RecordBatch.from_pylist(rows, schema)
    looked_at = []
    between = passages.passages_between
    monkeypatch.setattr(passages, "passages_between", lambda *a: looked_at.append(1) or between(*a))
    together = [r for b in passages._passage_rows(iter([batch]), PRODUCTION) for r in b.to_pylist()]
    few = len(looked_at)
    run = passages._run
    monkeypatch.setattr(passages, "_run", lambda *a: (run(*a)[0], run(*a)[1] & False))
    alone = [r for b in passages._passage_rows(iter([batch]), PRODUCTION) for r in b.to_pylist()]
    assert len(looked_at) - few == 400 and few < 300
    assert together == alone and len(alone) > 40


def test_short_extensions_equal_long_ones(monkeypatch):
    from loomgraph.llm import passages

    rng = random.Random(25)
    for _ in range(2000):
        a = np.array([rng.randrange(3) for _ in range(rng.randrange(150))], np.uint64)
        b = a.copy()
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b = np.concatenate([b[:at], np.array([9] * rng.randrange(3), np.uint64), b[at + rng.randrange(3) :]])
        near = passages._extend(a, b, 3)
        with monkeypatch.context() as m:
            m.setattr(passages, "_extend_near", lambda *_: None)
            assert passages._extend(a, b, 3) == near


def test_common_words_of_short_runs():
    from loomgraph.llm.passages import _common

    rng = random.Random(26)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert _common(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1][-1]


def test_pairs_that_share_a_few_words_by_chance_need_no_text(spark, make_docs, monkeypatch):
    from loomgraph.llm import passages

    rng = random.Random(24)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    seed, passage = fresh(6), fresh(70)
    texts = [[*fresh(rng.randrange(30)), *seed, *fresh(rng.randrange(30))] for _ in range(12)]  # five or six words in common
    texts += [[*fresh(i), *passage[:i], "new", *passage[i + 1 :], *fresh(i)] for i in (11, 22, 33)]
    compared, segments = [], passages._segments

    def counted(pairs, *rest):
        compared.extend(pairs.select("doc_id", "source_id").collect())
        return segments(pairs, *rest)

    monkeypatch.setattr(passages, "_segments", counted)
    docs = make_docs([" ".join(t) for t in texts]).select("doc_id", "text")
    found = passages.shared_passages(docs).collect()
    assert {(r.doc_id, r.source_id) for r in found} == {(13, 12), (14, 12), (14, 13)}
    assert len(compared) < 8  # words have short codes, so a few others stay
    # Where rows repeat an id, any of its texts may go on.
    ends = [[*seed, *fresh(60)], [*seed, *passage], [*seed, *fresh(50)], [*seed, *passage]]
    docs = docs.union(spark.createDataFrame([(i, " ".join(t)) for i, t in zip((20, 20, 21, 21), ends)], docs.schema))
    found = {tuple(r) for r in passages.shared_passages(docs).collect()}
    monkeypatch.setattr(passages, "_context_words", lambda settings: 0)
    assert found == {tuple(r) for r in passages.shared_passages(docs).collect()}
    assert any(r[:2] == (21, 20) for r in found)


def test_contexts_drop_no_segment(make_docs):
    from loomgraph.llm import passages

    rng = random.Random(25)
    texts = [[f"w{rng.randrange(3 + i % 9)}" for _ in range(rng.choice([6, 20, 60]))] for i in range(60)]
    docs = make_docs([" ".join(t) for t in texts]).select("doc_id", "text")
    hashes = [h for _, h in word_hashes(pa.array([" ".join(t) for t in texts]), lower=True)]
    settings = replace(PRODUCTION, min_segment=12, min_share=0.3)
    pairs = anchors(docs, settings)
    kept = {(r.doc_id, r.source_id) for r in passages._comparable(pairs, docs, settings).collect()}
    dropped = [r for r in pairs.collect() if (r.doc_id, r.source_id) not in kept]
    assert len(dropped) > 5
    for r in dropped:
        x, y = (np.array([a[f] for a in r.anchors]) for f in ("at", "source_at"))
        assert passages.passages_between(x, y, hashes[r.doc_id], hashes[r.source_id], settings) == []
