"""Collocations against brute force, with shards small enough to prune."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import phrases
from loomgraph.llm.hashing import windows, windows_at
from loomgraph.llm.phrases import PhraseSettings, collocations, frequent, shard_of

SCHEMA = "doc_id long, text string, lang string, n long, score int, phrase string, k int"


def brute(rows, support=4, longest=5, top=30):
    counts, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = collections.defaultdict(list)
    kept = {key: a for key, a in counts.items() if a >= support and len(key[1]) > 1}
    for (lang, w), a in kept.items():
        inside = any(
            other[0] == lang and len(other[1]) > len(w) and 100 * b >= 100 * a and any(other[1][i : i + len(w)] == w for i in range(len(other[1]) - len(w) + 1))
            for other, b in kept.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:k]], counts[lang, w[k:]]))
    return sorted(
        (lang, i, p.decode(), -a, l, r, n[lang], -score)
        for lang, rows in found.items() for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1))


def texts(rng, n):
    words = ["the", "The", "of", "New", "york", "é", "日本", "a", "b", "x" * 30, "end"]
    for i in range(n):
        parts = [rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "\x0b", " "]) for _ in range(rng.randint(0, 60))]
        yield i, "".join(parts), rng.choice(["en", "en", "fr", None, "und"])


@pytest.mark.parametrize("shipped", [1_000_000, 3])
@pytest.mark.parametrize("shard_words", [30, 100_000])
def test_collocations_match_brute_force(spark, shard_words, shipped):
    rng = random.Random(shard_words)
    rows = [*texts(rng, 200), (1, None, "en"), (2, "", None), (3, " \t ", "de"), (4, "one two " * 3000, "fr"), (None, "one two three", "fr")]
    frame = spark.createDataFrame([(*r, 5, 6, "p", 7) for r in rows], SCHEMA).repartition(7)
    settings = PhraseSettings(support=4, top=30, shard_words=shard_words, shipped=shipped, filter_bits=12)
    assert sorted(tuple(r) for r in collocations(frame, settings).collect()) == brute(rows)


def test_no_documents(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_products_above_64_bits(spark):
    frame = spark.createDataFrame([(1, "a b . " * 9, "en")], "doc_id long, text string, lang string")
    from loomgraph.llm import phrases
    counts = spark.createDataFrame([("en", 1, "a", 9 * 10**12), ("en", 1, "b", 8 * 10**12), ("en", 2, "a b", 7 * 10**12)], "lang string, k int, phrase string, f long")
    totals = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    real, phrases.phrase_counts = phrases.phrase_counts, lambda *_: (totals, counts)
    try:
        (row,) = collocations(frame).collect()
    finally:
        phrases.phrase_counts = real
    assert row.score == 1000 * 7 * 10**12 * 10**14 // (72 * 10**24)


def test_mining_a_shard_is_complete():
    rng = random.Random(5)
    words = [rng.choice("abcd") for _ in range(3000)]
    shard = shard_of([np.frombuffer(" ".join(words).encode(), np.uint8)])
    for k, first, count in frequent(shard, 20, 5):
        want = collections.Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        assert {tuple(words[i : i + k]): c for i, c in zip(first.tolist(), count.tolist())} == {w: c for w, c in want.items() if c >= 20}


def test_classes_of_runs_change_nothing(monkeypatch):
    rng = random.Random(6)
    words = [rng.choice("abcdefgh") + rng.choice([" ", " ", " ", ", "]) for _ in range(5000)]
    shard = shard_of([np.frombuffer("".join(words).encode(), np.uint8)])
    found = {}
    for size in (10_000, 70):
        monkeypatch.setattr(phrases, "_CLASS_WORDS", size)
        found[size] = [(k, sorted(zip(first.tolist(), count.tolist()))) for k, first, count in frequent(shard, 3, 5)]
    assert found[70] == found[10_000] and len(found[70]) == 5


def test_a_task_reports_a_phrase_once():
    rng = random.Random(7)
    rows = [(lang or "und", text) for _, text, lang in texts(rng, 400)]
    batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": t} for a, t in rows[at : at + 50]]) for at in range(0, 400, 50)]
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n-\r]", text.lower()):
            words = [w for w in re.split("[ \t]", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    settings = PhraseSettings(support=4, shard_words=100_000, block_words=30)
    # One task is one shard of each language, so it reports what is frequent in the whole, and nothing else.
    mined = [r for b in phrases._mined(iter(batches), totals, None, settings) for r in b.to_pylist()]
    assert sorted((r["lang"], r["k"], r["c"]) for r in mined if r["k"]) == sorted((lang, len(w), c) for (lang, w), c in counts.items() if len(w) < 3 and c >= 4)
    assert sorted(r["lang"] for r in mined if not r["k"]) == sorted(totals)
    pairs = phrases.Shipped(np.sort(np.array([r["id"] for r in mined if r["k"] == 2], np.int64).view(np.uint64)))
    mined += [r for b in phrases._mined(iter(batches), totals, pairs, settings) for r in b.to_pylist()]
    wanted = phrases.Shipped(np.sort(np.array([r["id"] for r in mined if r["k"]], np.int64).view(np.uint64)))
    told = [r for b in phrases._counted(iter(batches), totals, wanted, settings) for r in b.to_pylist()]
    assert sorted((r["lang"], tuple(r["phrase"].decode().split(" ")), r["f"]) for r in told) == sorted((lang, w, c) for (lang, w), c in counts.items() if c >= 4)


def test_counts_beyond_the_bound_are_reported_in_parts(monkeypatch):
    monkeypatch.setattr(phrases, "_HELD_COUNTS", 5)
    texts = [" ".join(["a b c", "d"] * 10)] * 20
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": t} for t in texts])
    settings = PhraseSettings(support=4, shard_words=100_000, block_words=30)
    ids = np.unique(np.concatenate([phrases.salted(windows(shard_of([np.frombuffer(texts[0].encode(), np.uint8)]).word, k), "en") for k in (1, 2)]))
    told = collections.Counter()
    names = {}
    for b in phrases._counted(iter([batch]), {"en": 800}, phrases.Shipped(ids), settings):
        for r in b.to_pylist():
            told[r["id"]] += r["f"]
            names[r["id"]] = names.get(r["id"]) or r["phrase"]
    assert {names[i]: f for i, f in told.items()} == {b"a": 200, b"b": 200, b"c": 200, b"d": 200, b"a b": 200, b"b c": 200, b"c d": 200, b"d a": 180}


def test_windows_at_places():
    hashes = np.random.default_rng(8).integers(0, 2**63, 50).astype(np.uint64)
    places = np.array([0, 7, 7, 45])
    for k in range(1, 6):
        assert windows_at(hashes, k, places).tolist() == windows(hashes, k)[places].tolist()
