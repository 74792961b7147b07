"""Vector search, code search and name search over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog.registry import query
from loomgraph.functions.embedding import cosine_similarity, hash_embedder
from loomgraph.functions.paths import matches_glob
from loomgraph.operators.names import keep_matches_or_all, name_matches
from loomgraph.operators.nearest import nearest
from loomgraph.operators.results import envelope
from loomgraph.plans import search
from loomgraph.settings import EMBEDDING_DIM
from loomgraph.sources.tables import benchmark_questions, document_nodes, spread, table

DISTANCE = "round(1 - list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 6) + 0.0"


@query(
    "vector_topk",
    f"""
    select v.vec_id, v.label, {DISTANCE} as distance
    from embeddings v, (select embedding from embeddings order by vec_id limit 1) q
    order by distance, v.vec_id limit 10
    """,
)
def vector_topk(spark, folder):
    """Closest ten vectors to the first one, with their label looked up afterwards."""
    stored = table(spark, folder, "embeddings")
    vectors = stored.select(F.col("vec_id").alias("id"), "embedding")
    asked = stored.orderBy("vec_id").limit(1).select(F.lit(0).alias("query_id"), "embedding")
    hits = nearest(vectors, asked, 10)
    return hits.join(
        stored.select(F.col("vec_id").alias("id"), "label"), "id"
    ).select(F.col("id").alias("vec_id"), "label", "distance")


@query(
    "knn_batch",
    f"""
    select q.vec_id as query_id, v.vec_id as id, {DISTANCE} as distance
    from embeddings q, embeddings v
    qualify row_number() over (partition by q.vec_id order by {DISTANCE}, v.vec_id) <= 10
    """,
)
def knn_batch(spark, folder):
    """Ten closest vectors of every vector."""
    stored = spread(table(spark, folder, "embeddings"))
    return nearest(
        stored.select(F.col("vec_id").alias("id"), "embedding"),
        stored.select(F.col("vec_id").alias("query_id"), "embedding"),
        10,
    )


@query(
    "vector_topk_multi_collection",
    f"""
    with q as (select label as query_id, arg_min(embedding, vec_id) as embedding
               from embeddings group by label),
    hits as (
        select q.query_id, v.vec_id // 3 as id, v.vec_id % 3 as collection, {DISTANCE} as distance
        from q, embeddings v
        qualify row_number() over (partition by q.query_id, v.vec_id % 3
                                   order by {DISTANCE}, v.vec_id // 3) <= 15),
    best as (select query_id, id, min(distance) as distance from hits group by query_id, id)
    select * from best
    qualify row_number() over (partition by query_id order by distance, id) <= 15
    """,
)
def vector_topk_multi_collection(spark, folder):
    """Nodes with three vectors each: per-collection top-k, smallest distance per node."""
    stored = table(spark, folder, "embeddings")
    vectors = stored.select(
        F.expr("vec_id div 3").alias("id"), F.expr("vec_id % 3").alias("collection"), "embedding"
    )
    asked = stored.groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("embedding")
    )
    return search.multi_collection_search(vectors, asked, 15)


@query(
    "pairwise_cosine",
    """
    select v.vec_id, coalesce(round(list_cosine_similarity(
        v.embedding::double[], c.embedding::double[]), 6), 0) as similarity
    from embeddings v join (select label, arg_min(embedding, vec_id) as embedding
                            from embeddings group by label) c using (label)
    """,
)
def pairwise_cosine(spark, folder):
    """Similarity of every vector to the first one of its label."""
    stored = table(spark, folder, "embeddings")
    heads = stored.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return stored.join(heads, "label").select(
        "vec_id", F.round(cosine_similarity(F.col("embedding"), F.col("head")), 6).alias("similarity")
    )


# --- text search over documents -------------------------------------------------


def words_sql(source: str, text: str) -> str:
    return f"""
        select id, ('0x' || md5(w)[1:4])::int % {EMBEDDING_DIM} as bucket, count(*)::double as n
        from (select id, unnest(regexp_extract_all(lower(regexp_replace(
                  {text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9]+')) as w
              from {source}) group by all"""


DOCS_SQL = """
    all_docs as (
        select doc_id as id, source as repo_id, text, n_chars::int as start_line,
            lang || '/' || sha256(text)[1:16] || case lang when 'en' then '.py' when 'fr' then '.ts'
                when 'de' then '.js' when 'es' then '.tsx' else '.txt' end as file_path
        from documents),
    docs as (select * from all_docs where {keep})"""


def search_sql(
    limit: int, template: str = "text", tail: str = "", collections: str = "0, 1", keep: str = "true"
) -> str:
    """SQL of the whole chain: filter, two collections, smallest distance, dedup, one cut."""
    return f"""
    with {DOCS_SQL.replace("{keep}", keep)},
    asked as (select item_id as id, {template} as text from benchmark),
    stored as (select id, 0 as collection, file_path as text from docs
               union all select id, 1, text from docs where trim(text) <> ''),
    qw as ({words_sql("asked", "text")}),
    sw as (select collection, id, bucket, n from (
        select 0 as collection, * from ({words_sql("(select id, file_path as text from docs)", "text")})
        union all
        select 1 as collection, * from ({words_sql("docs", "text")}))),
    qn as (select id, sqrt(sum(n * n)) as len from (select id, bucket, sum(n) as n from qw group by all) group by id),
    sn as (select collection, id, sqrt(sum(n * n)) as len
           from (select collection, id, bucket, sum(n) as n from sw group by all) group by all),
    dots as (select qw.id as query_id, sw.collection, sw.id, sum(qw.n * sw.n) as dot
             from qw join sw using (bucket) group by all),
    scored as (
        select a.id as query_id, d.repo_id, s.collection, s.id,
            round(1 - coalesce(dots.dot / (qn.len * sn.len), 0), 6) + 0.0 as distance
        from asked a cross join (select * from stored where collection in ({collections})) s
        join docs d on d.id = s.id
        left join dots on dots.query_id = a.id and dots.collection = s.collection and dots.id = s.id
        left join qn on qn.id = a.id
        left join sn on sn.collection = s.collection and sn.id = s.id),
    best as (select query_id, repo_id, id, min(distance) as distance from scored group by all),
    uniq as (
        select c.query_id, c.repo_id, c.id, d.file_path, d.start_line, c.distance
        from best c join docs d using (id)
        qualify row_number() over (partition by c.query_id, d.file_path, d.start_line
                                   order by c.distance, c.id) = 1),
    found as (select *, row_number() over (partition by query_id order by distance, id) as rank
              from uniq qualify rank <= {limit})
    {tail}"""


RESULT_SQL = "query_id, rank::int as rank, repo_id, id, file_path, start_line, distance, round(1 - distance, 6) as relevance"


def code_search_sql(top_k: int, template: str, keep: str) -> str:
    return search_sql(top_k, template, f"select {RESULT_SQL} from found", keep=keep)


def _results(found):
    return found.select(
        "query_id", "rank", "repo_id", "id", "file_path", "start_line", "distance", "relevance"
    )


def _corpus(spark, folder):
    nodes = document_nodes(spark, folder)
    return nodes, search.index_vectors(nodes), benchmark_questions(spark, folder)


@query("search_code_text", code_search_sql(10, "text", "true"))
def search_code_text(spark, folder):
    """Every benchmark text asked against all documents of all repositories."""
    return _results(search.search_code(*_corpus(spark, folder)))


@query(
    "search_lang_filter",
    code_search_sql(
        10, "'typescript ' || text", "file_path like '%.ts' or file_path like '%.tsx'"
    ),
)
def search_lang_filter(spark, folder):
    """Code search with a language: it joins the question and limits the files."""
    return _results(search.search_code(*_corpus(spark, folder), language="typescript"))


@query("search_glob_filter", code_search_sql(10, "text", "file_path glob '*n/*[0-7].py'"))
def search_glob_filter(spark, folder):
    return _results(search.search_code(*_corpus(spark, folder), file_pattern="*n/*[0-7].py"))


@query("semantic_search", search_sql(10, "text", f"select {RESULT_SQL} from found"))
def semantic_search(spark, folder):
    return _results(search.semantic_search(*_corpus(spark, folder)))


@query("quick_search", search_sql(10, "text", f"select {RESULT_SQL} from found", collections="1"))
def quick_search(spark, folder):
    """The same search over the short list of collections: no paths."""
    return _results(search.quick_search(*_corpus(spark, folder)))


@query(
    "dependencies_by_meaning",
    search_sql(20, "'imports dependencies of ' || text", f"select {RESULT_SQL} from found"),
)
def dependencies_by_meaning(spark, folder):
    return _results(search.get_dependencies(*_corpus(spark, folder)))


@query(
    "dependents_by_meaning",
    search_sql(20, "'what imports or calls or uses ' || text", f"select {RESULT_SQL} from found"),
)
def dependents_by_meaning(spark, folder):
    return _results(search.get_dependents(*_corpus(spark, folder)))


@query(
    "tool_envelope",
    search_sql(
        10,
        "text",
        """select f.query_id, b.text as query_text, count(*) as total,
              list('{"file":"' || file_path || '","name":"' || file_path || '","kind":"file"' ||
                  case when start_line <> 0 then ',"lines":[' || start_line || ',0]' else '' end ||
                  case when round(1 - distance, 6) <> 0
                       then ',"relevance":' || round(round(1 - distance, 6), 3) else '' end || '}'
                  order by rank) as results
           from found f join benchmark b on b.item_id = f.query_id group by all""",
    ),
)
def tool_envelope(spark, folder):
    """Responses as returned to a caller: result list in sparse JSON, total, question."""
    nodes, vectors, questions = _corpus(spark, folder)
    found = search.semantic_search(nodes, vectors, questions)
    return envelope(found.join(questions, "query_id"))


@query(
    "file_summary",
    """
    with n as (
        select p_brand || '.py' as file_path, p_name as name, p_type as signature, p_size as start_line, p_partkey % 4 as t,
               p_brand as module, 'import ' || p_name as statement from part
        union all select p_brand || '.py', null, null, 0, 4, null, null from part group by p_brand)
    select 'parts' as repo_id, file_path,
        case t when 0 then 'functions' when 1 then 'classes' when 2 then 'imports' else 'file' end as bucket,
        case t when 2 then module when 4 then file_path else name end as name,
        case t when 2 then statement when 4 then 'Summary of ' || file_path else signature end as text,
        start_line::int as start_line, start_line::int + 1 as end_line
    from n where t <> 3 and file_path like '%.py'
    """,
)
def file_summary(spark, folder):
    """Summaries of all files whose path ends in ``.py``: brands as files of functions, classes, imports, variables."""
    part = table(spark, folder, "part")
    kind = F.col("p_partkey") % 4
    of = lambda *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (kind + 1).cast("int"))
    path = F.concat("p_brand", F.lit(".py"))
    module, line = kind == 2, F.col("p_size").cast("int")
    symbols = part.select(
        F.lit("parts").alias("repo_id"), path.alias("file_path"), of("CodeFunction", "CodeClass", "CodeImport", "CodeVariable").alias("type"),
        of("method", "interface", None, "variable").alias("kind"), F.when(~module, F.col("p_name")).alias("name"),
        F.when(module, F.col("p_brand")).alias("source_module"), F.when(~module, F.col("p_type")).alias("signature"),
        F.when(module, F.concat(F.lit("import "), "p_name")).alias("import_statement"), line.alias("start_line"), (line + 1).alias("end_line"),
    )
    files = part.select(
        F.lit("parts").alias("repo_id"), path.alias("file_path"), F.lit("CodeFile").alias("type"), F.lit("file").alias("kind"),
        F.concat(F.lit("Summary of "), path).alias("summary"), F.lit(0).alias("start_line"), F.lit(1).alias("end_line"),
    ).distinct()
    nodes = symbols.unionByName(files, allowMissingColumns=True)
    return search.file_summary(nodes, ".py")


# --- names ----------------------------------------------------------------------

PART_NODES_SQL = """
    nodes as (select p_partkey as id, p_name as name, lower(p_type) as kind, p_brand as file_path,
                     p_size as start_line from part),
    asked as (select 'n:' || w as query_id, w as name, null as kind
              from (select distinct unnest(string_split(p_name, ' ')) as w from part)
              union all
              select 'k:' || kind, 'Widget Pro', kind from (select distinct lower(p_type) as kind from part)
              union all select 'x', 'no such name', null)"""


def _part_nodes(spark, folder):
    none = F.lit(None).cast("string")
    return spread(table(spark, folder, "part")).select(
        F.col("p_partkey").alias("id"),
        F.lit("parts").alias("repo_id"),
        F.lit("CodeFunction").alias("type"),
        F.col("p_name").alias("name"),
        F.lower("p_type").alias("kind"),
        F.col("p_brand").alias("file_path"),
        F.col("p_size").alias("start_line"),
        F.lit(0).alias("end_line"),
        none.alias("signature"),
        none.alias("docstring"),
        none.alias("import_statement"),
    )


def _part_questions(spark, folder):
    part = table(spark, folder, "part")
    none = F.lit(None).cast("string")
    words = part.select(F.explode(F.split("p_name", " ")).alias("name")).distinct()
    kinds = part.select(F.lower("p_type").alias("kind")).distinct()
    return (
        words.select(F.concat(F.lit("n:"), "name").alias("query_id"), "name", none.alias("kind"))
        .unionByName(
            kinds.select(
                F.concat(F.lit("k:"), "kind").alias("query_id"),
                F.lit("Widget Pro").alias("name"),
                "kind",
            )
        )
        .unionByName(
            spark.range(1).select(
                F.lit("x").alias("query_id"), F.lit("no such name").alias("name"), none.alias("kind")
            )
        )
    )


NAME_SEARCH_SQL = f"""
    with {PART_NODES_SQL},
    qw as ({words_sql("(select query_id as id, concat_ws(' ', kind, name) as text from asked)", "text")}),
    sw as ({words_sql("nodes", "name")}),
    qn as (select id, sqrt(sum(n * n)) as len from (select id, bucket, sum(n) as n from qw group by all) group by id),
    sn as (select id, sqrt(sum(n * n)) as len from (select id, bucket, sum(n) as n from sw group by all) group by id),
    dots as (select qw.id as query_id, sw.id, sum(qw.n * sw.n) as dot from qw join sw using (bucket) group by all),
    scored as (select a.query_id, s.id, s.name, s.kind, s.file_path, s.start_line, a.name as wanted, a.kind as wanted_kind,
            round(1 - coalesce(dot / (qn.len * sn.len), 0), 6) + 0.0 as distance
        from asked a cross join nodes s
        left join dots on dots.query_id = a.query_id and dots.id = s.id
        left join qn on qn.id = a.query_id left join sn on sn.id = s.id),
    judged as (select *, (contains(lower(name), lower(wanted)) or contains(lower(wanted), lower(name)))
            and (wanted_kind is null or kind = wanted_kind) as hit from scored
        qualify row_number() over (
            partition by query_id, name, file_path, start_line order by hit desc, distance, id) = 1),
    kept as (select * from judged qualify hit or not bool_or(hit) over (partition by query_id))
    select query_id, row_number() over (partition by query_id order by distance, id)::int as rank,
           id, name, kind, file_path, start_line, distance
    from kept qualify rank <= 20"""


@query("search_by_name", NAME_SEARCH_SQL)
def search_by_name(spark, folder):
    """All name words, all kinds and one unknown name asked against every part."""
    nodes = _part_nodes(spark, folder)
    found = search.search_by_name(
        nodes, search.index_vectors(nodes), _part_questions(spark, folder)
    )
    return found.select(
        "query_id", "rank", "id", "name", "kind", "file_path", "start_line", "distance"
    )


FIND_SYMBOL_SQL = (
    NAME_SEARCH_SQL.replace("select query_id, row_number()", ", ranked as (select query_id, row_number()")
    + """),
    edges as (select l_partkey, l_suppkey, l_returnflag from lineitem group by all)
    select r.query_id, r.rank, r.id, r.name, e.l_returnflag as relationship, s.s_name as target
    from ranked r
    left join (edges e join supplier s on s.s_suppkey = e.l_suppkey) on r.rank = 1 and e.l_partkey = r.id"""
)


@query("find_symbol", FIND_SYMBOL_SQL)
def find_symbol(spark, folder):
    """Name search with the edges of each best hit: parts linked to suppliers."""
    parts = _part_nodes(spark, folder).withColumn("id", F.concat(F.lit("p"), F.format_string("%012d", "id")))
    suppliers = table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    edges = table(spark, folder, "lineitem").select(
        F.concat(F.lit("p"), F.format_string("%012d", "l_partkey")).alias("from_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("to_id"),
        F.col("l_returnflag").alias("relationship_name"),
    ).distinct()
    nodes = parts.unionByName(suppliers, allowMissingColumns=True)
    found = search.find_symbol(
        nodes, search.index_vectors(parts), edges, _part_questions(spark, folder)
    )
    return found.select(
        "query_id", "rank", F.substring("id", 2, 12).cast("bigint").alias("id"), "name",
        "relationship", "target",
    )


@query(
    "name_match",
    """
    select p_partkey, p_name from part
    where contains(lower(p_name), 'ring') or contains('ring', lower(p_name))
    """,
)
def name_match(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return keep_matches_or_all(part, [], name_matches(F.col("p_name"), F.lit("Ring")))


@query("name_match_fallback", "select p_partkey, p_name from part")
def name_match_fallback(spark, folder):
    """Nothing matches, so everything stays."""
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return keep_matches_or_all(part, [], name_matches(F.col("p_name"), F.lit("q#z")))


@query("glob_paths", "select page_id, url from pages where url glob '*.example.org/en/*[0-4]*'")
def glob_paths(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return pages.filter(matches_glob(F.col("url"), "*.example.org/en/*[0-4]*"))


@query(
    "text_embedding",
    f"""
    with w as ({words_sql("(select doc_id as id, text from documents)", "text")}),
    b as (select id, bucket, sum(n) as n from w group by all)
    select d.doc_id, coalesce(sum(n), 0)::bigint as words, count(bucket) as buckets,
           coalesce(sum(n * n), 0)::bigint as squared
    from documents d left join b on b.id = d.doc_id group by d.doc_id""",
)
def text_embedding(spark, folder):
    """Embedding of every whole text, reduced to three exact numbers."""
    docs = spread(table(spark, folder, "documents").select("doc_id", "text"))
    vector = docs.select("doc_id", hash_embedder()(F.col("text")).cast("array<double>").alias("v"))
    add = lambda acc, x: acc + x
    return vector.select(
        "doc_id",
        F.aggregate("v", F.lit(0.0), add).cast("bigint").alias("words"),
        F.size(F.filter("v", lambda x: x > 0)).cast("bigint").alias("buckets"),
        F.aggregate(F.transform("v", lambda x: x * x), F.lit(0.0), add).cast("bigint").alias("squared"),
    )
