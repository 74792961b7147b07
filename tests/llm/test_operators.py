"""Operators against brute force."""

import collections
import math
import random
import re
import zlib

import pytest

from loomgraph.llm.components import components
from loomgraph.llm.licences import known_licences, licence_lookup
from loomgraph.llm.mixing import mix_report, targets
from loomgraph.llm.near import PRODUCTION as NEAR, least_matches, near_duplicates
from loomgraph.llm.passages import PassageSettings, _common, best_chains, shared_passages
from loomgraph.llm.pii import Field, LABELS, added_spans, base_spans, luhn, shape
from loomgraph.llm.risk import CUTOFFS, RiskSettings, binomial_tail, cutoffs, measured, quality_verdicts
from loomgraph.llm.sharding import shard_slots, sharded
from loomgraph.llm.tokens import Counter, load_vocabulary
from tests.llm.conftest import sentence

WORDS = re.compile("[^ \t-\r]+")


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingles(text):
    w = WORDS.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def test_near_duplicates_match_brute_force(make_docs):
    rng = random.Random(1)
    texts = []
    for _ in range(12):  # groups of copies with more and more changed words, so that links chain
        base = sentence(rng, rng.randint(8, 120)).split()
        for k in range(12):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 15))):
                words[rng.randrange(len(words))] = f"new{rng.randrange(999)}"
            texts.append(" ".join(words) if k % 4 else " ".join(words).upper())
    texts += ["a b c", "A B c", "a b", "", None, "one two three four five six seven eight", "one two three four five six seven"]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(make_docs(texts)).collect())
    assert got == near_brute(texts)


def test_pruning_keeps_pairs_at_the_threshold():
    for n, m in least_matches(NEAR):
        missed = sum(math.comb(n + 1, k) * 0.75**k * 0.25 ** (n + 1 - k) for k in range(m))
        assert missed < NEAR.miss


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201), (200, 201)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(101, 100), (102, 100), (201, 200)}


def patterns(text):
    out = []
    for kind, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 13 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if fits:
                out.append((kind, *m.span()))
    return sorted(out)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(2)
    for _ in range(8000):
        text = "".join(rng.choice("a@.+0123456789- ()é\nb") for _ in range(rng.randint(0, 60)))
        assert sorted(base_spans(text)) == patterns(text)


def test_field_carries_a_label_to_the_same_number():
    import numpy as np

    agree = np.full((len(LABELS),) * 2, -3.0)
    np.fill_diagonal(agree, 4.6)
    field = Field({shape("33612345678"): (-3.0, -3.0, -3.0, -1.0, -1.0)}, np.zeros((len(LABELS),) * 2), agree)
    text = "call +33612345678 or write to 33612345678 today, not 33612345679"
    assert added_spans(text, base_spans(text), field) == [(3, 30, 41)]
    assert added_spans("only 33612345678 and 33612345678", [], field) == []


def test_measures_match_brute_force(make_docs):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab #*$é!A\n \t") for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["a b c " * 40]
    got = {r.doc_id: r for r in measured(make_docs(texts)).collect()}
    for i, text in enumerate(texts):
        w = WORDS.findall(text)
        times = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if times[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))


def test_binomial_tail_is_exact():
    for n, p in ((1, 0.5), (40, 0.1), (300, 0.004), (2000, 0.02)):
        for k in {0, 1, n // 50, n // 10, n - 1, n}:
            exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) if n <= 300 else None
            if exact is not None:
                assert binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert binomial_tail(0, 2000, 0.02) == pytest.approx(0.98**2000, rel=1e-9)


def test_certified_cutoffs_reject_junk_and_keep_the_clean(spark, make_docs):
    rng = random.Random(5)
    texts = [sentence(rng, 60) if i % 4 else sentence(rng, 60).replace(" ", "### ") for i in range(4000)]
    docs = make_docs(texts)
    marks = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(4000) if i % 10 != 9], "doc_id long, quality int, toxic int")
    chosen = cutoffs(measured(docs), marks).collect()
    assert [r.rule for r in chosen] == ["symbols"] and chosen[0].false_rejects == 0
    share, tests = RiskSettings().limit / 5, 5
    assert all(binomial_tail(r.false_rejects, r.n_good, share) <= RiskSettings().level / tests and r.cutoff in CUTOFFS for r in chosen)
    assert all(r.kept == (r.doc_id % 4 > 0) for r in quality_verdicts(docs, marks).collect())
    few = marks.where("doc_id < 100")
    assert all(r.kept for r in quality_verdicts(docs, few).collect())


def test_small_strata_certify_joint_cutoffs(spark, make_docs):
    from pyspark.sql import functions as F

    rng = random.Random(11)
    # Four strata with 240 good documents each; junk by symbols and, in two of them, by exclamation marks.
    texts = [sentence(rng, 60) if i % 5 else sentence(rng, 60).replace(" ", "### " if i % 2 else "!!! ") for i in range(1200)]
    docs = make_docs(texts).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 4))
    marks = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    settings = RiskSettings()
    chosen = cutoffs(measured(docs), marks).collect()
    kept = {r.doc_id: r.kept for r in quality_verdicts(docs, marks).collect()}
    assert {r.stratum for r in chosen} == {"l0", "l1", "l2", "l3"}
    for r in chosen:
        good = [i for i in range(1200) if i % 5 and i % 4 == int(r.stratum[1])]
        assert (r.n_good, r.false_rejects) == (len(good), sum(not kept[i] for i in good))
        assert binomial_tail(r.false_rejects, r.n_good, settings.limit) <= settings.level / 4
    assert all(kept[i] == (i % 5 > 0) for i in range(1200))


def test_joint_cutoffs_only_tighten():
    from loomgraph.llm.risk import JOINT_CUTOFFS, RULES

    for a, b in zip(JOINT_CUTOFFS, JOINT_CUTOFFS[1:]):
        assert a != b and all(b[rule] <= cutoff for rule, cutoff in a.items())
    assert JOINT_CUTOFFS[-1] == {rule: CUTOFFS[-1] for rule in RULES}


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_follow_the_published_algorithm(spark, make_docs):
    import hashlib

    docs = make_docs([f"text {i}" * (i % 3) for i in range(300)])
    rows = shard_slots(docs).collect()
    for r in rows:
        key = int(hashlib.md5(f"={r.doc_id}".encode()).hexdigest()[:16], 16)
        text = (f"text {r.doc_id}" * (r.doc_id % 3)).encode()
        assert (r.shard, r.grown_shard, r.size, r.text_crc32) == (jump(key, 8), jump(key, 9), len(text) + 1, zlib.crc32(text))
        assert r.grown_shard in (r.shard, 8)
    for n in (1, 2, 50):
        assert all(r.shard == jump(int(hashlib.md5(f"={r.doc_id}".encode()).hexdigest()[:16], 16), n) for r in sharded(docs, n).collect())


def test_shards_are_exact_at_the_word_border(spark):
    """Keys whose state has a low word just below 2^32, where rounded quotients are one too large."""
    from loomgraph.llm.sharding import jump_shard, stable_key
    from pyspark.sql import functions as F

    step, two64, rng = 2862933555777941757, 2**64, random.Random(9)
    back = pow(step, -1, two64)
    keys = [((rng.randrange(2**32) << 32 | 2**32 - 1 - rng.randrange(2200)) - back_step) * pow(back, n, two64) % two64
            for _ in range(1500) for n in (0, 1) for back_step in (n,)]
    frame = spark.createDataFrame([(str(k),) for k in keys + [0, 1, two64 - 1]], "k string")
    key = F.col("k").cast("decimal(38,0)")
    for r in frame.select("k", jump_shard(key, 8).alias("eight"), jump_shard(key, 9).alias("nine"), jump_shard(key, 300).alias("many")).collect():
        assert (r.eight, r.nine, r.many) == tuple(jump(int(r.k), n) for n in (8, 9, 300))
    ids = spark.createDataFrame([(453274,), (4576462,), (6214314,)], "doc_id long")
    assert [r[0] for r in ids.select(jump_shard(stable_key(F.col("doc_id")), 8)).collect()] == [7, 6, 0]
    many = spark.range(0, 400_000, numPartitions=4).select(jump_shard(stable_key(F.col("id")), 8).alias("s"))
    assert many.agg(F.min("s"), F.max("s")).first()[:] == (0, 7)


def test_targets_stop_at_the_cap():
    got = targets([("b", 100), ("a", 10), (None, 1000), ("c", 100)], (1, 2, 3), 3)
    assert got["a"] == 30 and got["b"] == 300 and got["c"] == 300 and got[None] == pytest.approx(580)
    assert targets([("a", 0), ("b", 5)], (1, 2, 3), 3) == {"a": 0.0, "b": 5.0}


def test_mix_meets_targets(make_docs):
    rng = random.Random(6)
    texts = [sentence(rng, min(3000, int(rng.expovariate(1 / 80)) + 1)) for _ in range(900)]
    source = [rng.choice("abcd") for _ in texts]
    docs = make_docs(texts, source)
    rows = mix_report(docs).collect()
    taken, goal = collections.Counter(), {}
    for r in rows:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and r.source_size > 0
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
    for s, t in goal.items():
        assert taken[s] == pytest.approx(t, rel=0.02)
    again = mix_report(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_licences_ignore_case_punctuation_copyright_and_spelling(spark, make_docs):
    from loomgraph.llm.licences import KNOWN_TEXTS

    mit = next(t for n, t in KNOWN_TEXTS if n == "MIT")
    texts = ["Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(".", " ;"), mit + " more", "intro\n* released under the mit LICENCE!\nend", None]
    got = [(r.licence, r.n_notices, r.notices) for r in licence_lookup(make_docs(texts), known_licences(spark)).orderBy("doc_id").collect()]
    assert got == [("MIT", 0, ""), (None, 0, ""), (None, 1, "MIT"), (None, 0, "")]


def test_passages_cover_exact_repeats_and_survive_edits(make_docs):
    rng = random.Random(7)
    passage = sentence(rng, 70).split()
    edited = [w if i % 25 else "changed" for i, w in enumerate(passage)]
    texts = [sentence(rng, 100) + " " + " ".join(passage) + " " + sentence(rng, 30), sentence(rng, 400),
             sentence(rng, 20) + " " + " ".join(passage) + " " + sentence(rng, 200), sentence(rng, 5) + " " + " ".join(edited) + " " + sentence(rng, 9)]
    rows = shared_passages(make_docs(texts)).collect()
    assert {r.doc_id for r in rows} == {2, 3}
    exact = next(r for r in rows if r.doc_id == 2)
    assert (exact.source_id, exact.start_word, exact.end_word, exact.source_start, exact.n_equal) == (0, 20, 90, 100, 70)
    fuzzy = [r for r in rows if r.doc_id == 3]
    assert max(r.passage_end - r.passage_start for r in fuzzy) >= 60


@pytest.mark.parametrize("every", [8, 9, 10, 12])
def test_passages_with_frequent_edits_match_brute_force(make_docs, every):
    rng = random.Random(every)
    texts = [sentence(rng, 150).split() for _ in range(24)]
    for i in range(12):  # half of the texts give 60 words to another one, with an edit in every few
        passage = [w if (k + i) % every else f"new{rng.randrange(999)}" for k, w in enumerate(texts[i][40:100])]
        at = rng.randrange(60)
        texts[12 + i][at : at + 60] = passage

    def share(a, b):
        """The largest share of equal words of 50 in a row, at any offset of the texts."""
        most = 0
        for shift in range(50 - len(b), len(a) - 49):
            same = [a[x] == b[x - shift] for x in range(max(0, shift), min(len(a), len(b) + shift))]
            most = max([most, *(sum(same[x : x + 50]) for x in range(len(same) - 49))])
        return most / 50

    brute = {(i, j) for i in range(len(texts)) for j in range(i) if share(texts[i], texts[j]) >= PassageSettings().min_share}
    assert brute == {(12 + i, i) for i in range(12)}
    rows = shared_passages(make_docs([" ".join(t) for t in texts])).collect()
    assert {(r.doc_id, r.source_id) for r in rows} == brute
    assert all(r.passage_end - r.passage_start >= 50 for r in rows)


def test_chains_match_quadratic_search():
    import numpy as np

    settings = PassageSettings()
    rng = random.Random(8)
    for _ in range(30):
        n = rng.randint(1, 25)
        x, y = (np.array([rng.randrange(120) for _ in range(n)]) for _ in "xy")
        score = {}
        for i in sorted(range(n), key=lambda i: (x[i], y[i])):
            # The tree compares predecessors by score plus place, as the recurrence does.
            before = [j for j in score if x[j] < x[i] and y[j] < y[i]]
            best = max((score[j] + settings.gap_cost * (x[j] + y[j]), j) for j in before)[1] if before else None
            score[i] = settings.seed_words
            if best is not None:
                dx, dy, k = x[i] - x[best], y[i] - y[best], settings.seed_words
                score[i] = max(k, score[best] + min(k, dx, dy) - settings.gap_cost * (max(0, dx - k) + max(0, dy - k)))
        chains = best_chains(x, y, settings)
        assert sorted(i for c in chains for i in c) == list(range(n))
        for c in chains:
            assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(c, c[1:]))
        assert chains[0][-1] in {i for i in score if score[i] == pytest.approx(max(score.values()))}


def test_common_words_in_order():
    import numpy as np

    rng = random.Random(9)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(9))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        assert _common(np.array(a), np.array(b)) == table[-1][-1]


def test_counts_equal_the_tokenizer_library():
    from tokenizers import Tokenizer, models

    vocabulary = load_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    low = min(vocabulary.scores)
    pieces = [("<unk>", low), *zip(vocabulary.pieces, vocabulary.scores), *((f"<0x{i:02X}>", low) for i in range(256))]
    library, counter = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True)), Counter(vocabulary)
    rng = random.Random(10)
    texts = ["", "  a  b ", "日本語", "🙂🙂 a🙂", "\n\n\t x", "<0x41> </s>", "aaaa" * 900]
    texts += ["".join(rng.choice("abe thnr  éü\n🙂日") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in texts:
        expected = len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0
        assert counter.text(text)[1] == expected
