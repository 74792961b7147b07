"""Search plans. Every plan answers a whole table of questions in one pass.

``nodes`` and ``vectors`` follow :mod:`loomgraph.schema`; ``questions`` has
``query_id`` and ``query_text``. Filters run before the scoring, and copies of one
result count once before anything is cut, so k results come back wherever k exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomgraph.functions.embedding import Embedder, hash_embedder
from loomgraph.functions.paths import matches_glob, matches_language, same_file
from loomgraph.operators.graph import neighbours_of
from loomgraph.operators.names import match_matrix
from loomgraph.operators.nearest import nearest
from loomgraph.operators.results import node_result
from loomgraph.operators.topk import top_k
from loomgraph.schema import (
    INDEX_FIELDS,
    NAME_COLLECTIONS,
    QUICK_COLLECTIONS,
    SEARCH_COLLECTIONS,
)

CLOSEST_FIRST = ("distance", "id")


def _closest() -> list[Column]:
    return [F.col(c) for c in CLOSEST_FIRST]


def index_vectors(nodes: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """One vector per node and indexed text field; empty texts are skipped."""
    embed = embed or hash_embedder()
    blank = F.lit("")

    def known(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in nodes.columns else F.lit(None).cast(kind)

    # What makes two results the same to a reader; see node_result.
    copy_key = F.xxhash64(
        F.coalesce(F.nullif(known("name"), blank), known("import_statement"), F.col("file_path"), blank),
        F.coalesce(F.col("file_path"), blank),
        F.coalesce(known("start_line", "int"), F.lit(0)).cast("long"),
    )
    fields = sorted({f for names in INDEX_FIELDS.values() for f in names} & set(nodes.columns))
    indexed = reduce(
        lambda acc, item: acc | ((F.col("type") == item[0]) & F.col("_f.field").isin(*item[1])),
        INDEX_FIELDS.items(),
        F.lit(False),
    )
    unpivoted = (
        nodes.select(
            "repo_id",
            "file_path",
            "id",
            "type",
            F.coalesce(known("kind"), F.col("type")).alias("kind"),
            copy_key.alias("copy_key"),
            F.explode(
                F.array(
                    *[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields]
                )
            ).alias("_f"),
        )
        .filter(indexed & F.col("_f.text").isNotNull() & (F.trim("_f.text") != ""))
        .select(
            "repo_id",
            "file_path",
            F.concat_ws("_", "type", "_f.field").alias("collection"),
            "id",
            "kind",
            "copy_key",
            F.col("_f.text").alias("text"),
        )
    )
    return unpivoted.withColumn("embedding", embed(F.col("text")))


def multi_collection_search(
    vectors: DataFrame, questions: DataFrame, limit: int, groups: Sequence[str] = ()
) -> DataFrame:
    """Smallest distance per id over all collections, cut to ``limit`` per question."""
    hits = nearest(vectors, questions, limit, groups=[*groups, "collection"])
    best = hits.groupBy("query_id", *groups, "id").agg(F.min("distance").alias("distance"))
    return top_k(best, ["query_id", *groups], _closest(), limit)


def _search(
    nodes: DataFrame,
    vectors: DataFrame,
    embedded: DataFrame,
    limit: int,
    collections: Sequence[str],
    repo_id: str | None,
    where: Column | None = None,
    match: tuple[str, ...] = (),
) -> DataFrame:
    """The closest ``limit`` distinct results per question, with their node's columns.

    ``where`` filters vectors. With ``match`` columns on the questions, results of a
    matching name and kind come first, as their similarity is raised by MATCH_BONUS.
    """
    pool = vectors.filter(F.col("collection").isin(*collections))
    if repo_id is not None:
        pool = pool.filter(F.col("repo_id") == repo_id)
        nodes = nodes.filter(F.col("repo_id") == repo_id)
    if where is not None:
        pool = pool.filter(where)
    hits = nearest(
        pool, embedded, limit, copies="copy_key", carry=["repo_id"],
        extra=["text", "kind", *match] if match else (), bonus=_name_bonus if match else None,
    )
    lookup = nodes.select(
        "id", "repo_id", "type", "name", "kind", "file_path", "start_line", "end_line",
        "signature", "docstring", "import_statement",
    )
    # The hits are the small side: adaptive execution broadcasts them at run time.
    hydrated = hits.join(lookup, ["repo_id", "id"]).select("query_id", "repo_id", *node_result())
    return top_k(hydrated, ["query_id"], _closest(), limit, rank="rank").drop("dedup_name")


MATCH_BONUS = 10.0


def _name_bonus(rows, asked):
    return MATCH_BONUS * match_matrix(rows["text"], rows["kind"], asked["_wanted"], asked["_kind"])


def semantic_search(
    nodes: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    top_k_rows: int = 10,
    repo_id: str | None = None,
    embed: Embedder | None = None,
    collections: Sequence[str] = SEARCH_COLLECTIONS,
    template: str = "{}",
    where: Column | None = None,
) -> DataFrame:
    """Ranked results per question over the given collections of one or all repositories.

    ``where`` is a condition on the vectors' columns.
    """
    embed = embed or hash_embedder()
    before, after = template.split("{}")
    asked = F.concat(F.lit(before), F.col("query_text"), F.lit(after))
    embedded = questions.select("query_id", embed(asked).alias("embedding"))
    return _search(nodes, vectors, embedded, top_k_rows, collections, repo_id, where)


def quick_search(nodes, vectors, questions, top_k_rows=10, repo_id=None, embed=None) -> DataFrame:
    return semantic_search(
        nodes, vectors, questions, top_k_rows, repo_id, embed, QUICK_COLLECTIONS
    )


def search_code(
    nodes: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    top_k_rows: int = 10,
    language: str | None = None,
    file_pattern: str | None = None,
    repo_id: str | None = None,
    embed: Embedder | None = None,
) -> DataFrame:
    """Code search among the files of a language and path pattern."""
    template = (language.replace("{", "").replace("}", "") + " {}") if language else "{}"
    path = F.col("file_path")
    where = matches_language(path, language) & matches_glob(path, file_pattern)
    return semantic_search(
        nodes, vectors, questions, top_k_rows, repo_id, embed, template=template, where=where
    )


def search_by_name(
    nodes: DataFrame,
    vectors: DataFrame,
    questions: DataFrame,
    top_k_rows: int = 20,
    repo_id: str | None = None,
    embed: Embedder | None = None,
) -> DataFrame:
    """Symbols by name. ``questions`` has ``query_id, name`` and optionally ``kind``.

    All symbols are matched by name and kind in the scoring pass. A question gets its
    closest matches, or the closest symbols of any name where nothing matches.
    """
    embed = embed or hash_embedder()
    if "kind" not in questions.columns:
        questions = questions.withColumn("kind", F.lit(None).cast("string"))
    wanted = questions.select(
        "query_id", F.col("name").alias("_wanted"), F.nullif("kind", F.lit("")).alias("_kind")
    )
    embedded = wanted.withColumn("embedding", embed(F.concat_ws(" ", "_kind", "_wanted")))
    found = _search(
        nodes, vectors, embedded, top_k_rows, NAME_COLLECTIONS, repo_id, match=("_wanted", "_kind")
    )
    hit = F.col("distance") < 2 - MATCH_BONUS / 2
    any_hit = found.groupBy("query_id").agg(F.bool_or(hit).alias("_any"))
    kept = found.join(any_hit, "query_id").filter(hit | ~F.col("_any")).drop("_any")
    plain = F.round(F.when(hit, F.col("distance") + MATCH_BONUS).otherwise(F.col("distance")), 6)
    return kept.withColumn("distance", plain).withColumn("relevance", F.round(1 - plain, 6))


def find_symbol(
    nodes: DataFrame,
    vectors: DataFrame,
    edges: DataFrame,
    questions: DataFrame,
    include_relationships: bool = True,
    repo_id: str | None = None,
    embed: Embedder | None = None,
    top_k_rows: int = 20,
) -> DataFrame:
    """Name search whose best result carries its one-hop relationships.

    One row per result, repeated for rank 1 once per relationship: a hub may have
    any number of edges, so they stay rows and are never gathered into a list.
    """
    results = search_by_name(nodes, vectors, questions, top_k_rows, repo_id, embed)
    names = ("source", "relationship", "target")
    if not include_relationships:
        return results.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
    primary = results.filter("rank = 1").select("query_id", "rank", F.col("id").alias("node_id"))
    around = neighbours_of(edges, nodes, primary.select("node_id").distinct())
    attached = primary.join(around, "node_id").select("query_id", "rank", *names)
    return results.join(attached, ["query_id", "rank"], "left")


def get_dependencies(nodes, vectors, targets, repo_id=None, embed=None, top_k_rows=20) -> DataFrame:
    """What a file or symbol depends on, by meaning (see graph.reachable for by edge)."""
    return semantic_search(
        nodes, vectors, targets, top_k_rows, repo_id, embed, template="imports dependencies of {}"  # fixed value
    )


def get_dependents(nodes, vectors, targets, repo_id=None, embed=None, top_k_rows=20) -> DataFrame:
    """What depends on a file or symbol, by meaning."""
    return semantic_search(
        nodes, vectors, targets, top_k_rows, repo_id, embed, template="what imports or calls or uses {}"  # fixed value
    )


def file_summary(nodes: DataFrame, path: str, repo_id: str | None = None) -> DataFrame:
    """Stored summary of the files matching ``path`` and their symbols in buckets, as rows."""
    scope = nodes.filter(same_file(F.col("file_path"), path))
    if repo_id is not None:
        scope = scope.filter(F.col("repo_id") == repo_id)
    bucket = (
        F.when(F.col("type") == "CodeFile", "file")
        .when(F.col("kind").isin("function", "method", "arrow"), "functions")
        .when(F.col("kind").isin("class", "interface", "type_alias"), "classes")
        .when(F.col("type") == "CodeImport", "imports")
    )
    return (
        scope.withColumn("bucket", bucket)
        .filter("bucket is not null")
        .select(
            "repo_id",
            "file_path",
            "bucket",
            F.coalesce("name", "source_module", "file_path").alias("name"),
            F.coalesce("summary", "signature", "import_statement").alias("text"),
            "start_line",
            "end_line",
        )
    )
