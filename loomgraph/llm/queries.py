"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from loomgraph.llm.codes import codes_sql, vector_codes
from loomgraph.llm.common import documents
from loomgraph.llm.contamination import leaks
from loomgraph.llm.licences import known_licences, licence_lookup, lookup_sql
from loomgraph.llm.lines import dedup_sql, line_dedup
from loomgraph.llm.mixing import mix_report
from loomgraph.llm.near import near_duplicates
from loomgraph.llm.passages import shared_passages
from loomgraph.llm.phrases import collocations, phrases_sql
from loomgraph.llm.pii import find_personal_data
from loomgraph.llm.risk import quality_verdicts
from loomgraph.llm.sharding import shard_slots
from loomgraph.llm.tokens import load_vocabulary, token_counts
from loomgraph.llm.warc import archived_pages, archived_sql
from loomgraph.sources.tables import table

#: A sentencepiece model whose pieces and scores serve as the unigram vocabulary.
VOCABULARY_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    return find_personal_data(documents(spark, sf_dir))


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base measures, base_failed, kept."""
    return quality_verdicts(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, licence, n_notices, notices."""
    return licence_lookup(documents(spark, sf_dir), known_licences(spark))


def op4_suffix_array_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_deleted, longest_run, kept_sha256."""
    return line_dedup(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("text", 256)).drop("text")


def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies."""
    return mix_report(documents(spark, sf_dir))


def op6_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_slots(documents(spark, sf_dir))


def op7_bayesian_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return near_duplicates(documents(spark, sf_dir))


def op8_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source_id, passage_start, passage_end and the segment's spans."""
    return shared_passages(documents(spark, sf_dir))


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared of every leaked item."""
    return leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_count_only_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, best_score."""
    return token_counts(documents(spark, sf_dir), load_vocabulary(VOCABULARY_FILE))


def op11_splittable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return archived_pages(table(spark, sf_dir, "pages"))


def op12_son_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    return collocations(documents(spark, sf_dir))


def op13_anchor_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_risk_controlled_rules": op2_risk_controlled_rules,
    "op3_licence_digests": op3_licence_digests,
    "op4_suffix_array_lines": op4_suffix_array_lines,
    "op5_entropy_balanced_mix": op5_entropy_balanced_mix,
    "op6_jump_hash_shards": op6_jump_hash_shards,
    "op7_bayesian_near_duplicates": op7_bayesian_near_duplicates,
    "op8_collinear_passages": op8_collinear_passages,
    "op9_minhash_containment": op9_minhash_containment,
    "op10_count_only_viterbi": op10_count_only_viterbi,
    "op11_splittable_warc": op11_splittable_warc,
    "op12_son_collocations": op12_son_collocations,
    "op13_anchor_tree_codes": op13_anchor_tree_codes,
    "pipeline": corpus_pipeline.run,
}

_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\v\f\r]+'), lambda x: x <> '')"

SQL: dict[str, str] = {
    "op3_licence_digests": lookup_sql(),
    "op4_suffix_array_lines": dedup_sql(),
    "op11_splittable_warc": archived_sql(),
    "op12_son_collocations": phrases_sql(),
    "op13_anchor_tree_codes": codes_sql(),
    "op9_minhash_containment": f"""
        with i as (select item_id, {_TOKENS} w from benchmark),
        k as (select item_id, w, least(5, len(w)) k from i where len(w) > 0),
        item as (select distinct item_id, k, array_to_string(w[p : p + k - 1], ' ') s
                 from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) p from k)),
        d as (select doc_id, {_TOKENS} w from documents),
        doc as (select distinct doc_id, k, array_to_string(w[p : p + k - 1], ' ') s
                from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) p
                      from d, (select distinct k from k) where len(w) >= k)),
        sizes as (select item_id, count(*) n from item group by item_id)
        select doc_id, item_id, n::int n_item_shingles, count(*)::int n_shared
        from doc join item using (k, s) join sizes using (item_id)
        group by doc_id, item_id, n having 100 * count(*) >= 75 * n
    """,
}
