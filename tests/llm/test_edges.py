"""Every operator and stage on nulls, odd texts, repeated rows, clashing names and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm.contamination import leaks
from loomgraph.llm.licences import known_licences, licence_lookup
from loomgraph.llm.lines import line_dedup
from loomgraph.llm.mixing import mix_report, mixed
from loomgraph.llm.near import near_duplicates
from loomgraph.llm.passages import shared_passages
from loomgraph.llm.pii import find_personal_data
from loomgraph.llm.risk import quality_verdicts
from loomgraph.llm.sharding import shard_slots
from loomgraph.llm.tokens import Vocabulary, token_counts
from tests.llm.conftest import sentence

VOCABULARY = Vocabulary(("▁", "a", "b", "ab", "▁a"), (-2.0, -1.0, -1.0, -1.5, -1.5), True)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "same line here same line"), (None, "another text under a known")], "item_id long, text string")


OPERATORS = {
    "pii": lambda spark, docs: find_personal_data(docs),
    "rules": lambda spark, docs: quality_verdicts(docs, labels(spark)),
    "licences": lambda spark, docs: licence_lookup(docs, known_licences(spark)),
    "lines": lambda spark, docs: line_dedup(docs),
    "mix": lambda spark, docs: mix_report(docs),
    "mixed": lambda spark, docs: mixed(docs),
    "shards": lambda spark, docs: shard_slots(docs),
    "near": lambda spark, docs: near_duplicates(docs),
    "tokens": lambda spark, docs: token_counts(docs, VOCABULARY),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, edge_docs, no_docs, name):
    out = OPERATORS[name](spark, edge_docs)
    assert out.count() == edge_docs.count()
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(str(r[0]) for r in edge_docs.select("doc_id").collect())
    assert OPERATORS[name](spark, no_docs).count() == 0


def test_leaks_and_passages(spark, edge_docs, no_docs):
    found = {(r.doc_id, r.item_id) for r in leaks(edge_docs, items(spark)).collect()}
    # A one-word item is found as a word, in any case; blank items never.
    assert found == {(6, 3), (7, 3), (10, 4), (8, None)}
    assert leaks(no_docs, items(spark)).count() == 0 and leaks(edge_docs, items(spark).limit(0)).count() == 0
    pairs = {(r.doc_id, r.source_id) for r in shared_passages(edge_docs).collect()}
    assert (2, 1) in pairs and (9, 8) in pairs and all(a and b and b < a for a, b in pairs)
    assert shared_passages(no_docs).count() == 0


def test_defined_results_of_odd_rows(spark, edge_docs):
    near = near_duplicates(edge_docs).collect()
    assert all(r.kept and r.component_id == r.doc_id for r in near if r.n_shingles == 0)
    assert all(r.kept and r.component_id is None for r in near if r.doc_id is None)
    assert {(r.doc_id, r.component_id) for r in near if r.doc_id in (1, 2)} == {(1, 1), (2, 1)}
    slots = shard_slots(edge_docs).collect()
    for shard in {r.shard for r in slots}:
        own = sorted(r.slot for r in slots if r.shard == shard)
        assert own == list(range(len(own)))
    mix = mix_report(edge_docs).collect()
    assert all(r.taken == 0 for r in mix if r.size == 0) and all(r.taken <= 3 * r.size for r in mix)
    lines = {r.doc_id: r for r in line_dedup(edge_docs).collect()}
    assert lines[10].n_deleted == 29 and lines[10].longest_run == 29 and lines[10].text == "same line here"
    assert lines[3].text == "" and lines[3].n_deleted == 0
    # The long text comes again with a changed last line.
    assert lines[9].n_deleted == 899


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_documents(spark, edge_docs, no_docs, tmp_path, stage):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, edge_docs, str(tmp_path))
    assert set(edge_docs.columns) <= set(out.columns)
    assert out.where(F.col("doc_id").isNotNull()).join(edge_docs.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
    assert run(spark, no_docs, str(tmp_path)).count() == 0


def test_stages_judge_rows_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(12)
    a, b, c = (sentence(rng, 80) for _ in "abc")
    item = "one two three four five six seven eight"
    rows = [(5, a), (5, a), (None, a), (3, a), (5, b), (None, b), (None, c), (None, c), (None, None), (None, None), (9, ""), (3, "too short"),
            (None, "too short"), (None, f"{sentence(rng, 70)} {item}"), (6, f"{sentence(rng, 70)} {item}"), (6, sentence(rng, 90))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")

    def order(row):
        return row[0] is None, row[0] or 0, row[1] is None, row[1] or ""

    def one_of_each(rows):  # the copies here are exact; wordless texts are nobody's
        first = {}
        for row in sorted(rows, key=order):
            first.setdefault(row[1] or object(), row)
        return list(first.values())

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")

    expected = [[r for r in rows if len((r[1] or "").split()) >= 50], one_of_each(rows), [r for r in rows if item not in (r[1] or "")]]
    for (name, stage), left in zip(corpus_pipeline.STAGES, expected):
        for given in (docs, read):  # rows numbered when written, and by their place in files
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=order) == sorted(left, key=order), name


def test_mixing_and_sharding_keep_own_columns(spark, edge_docs):
    names = [c for c in edge_docs.columns if c != "shard"]
    for stage in (corpus_pipeline.mix, corpus_pipeline.shard):
        out = stage(spark, edge_docs, "")
        assert {tuple(r) for r in out.select(*names).collect()} <= {tuple(r) for r in edge_docs.select(*names).collect()}
        assert {tuple(r) for r in out.select("size", "target", "copies").collect()} == {(7, 1.0, 6)}
