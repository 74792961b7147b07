"""File discovery, hashing, snapshots and index status over documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomgraph.catalog.registry import query
from loomgraph.functions.paths import file_name, is_indexable, language_of, repo_id_of
from loomgraph.operators import digests, discovery, snapshots
from loomgraph.operators.ancestors import nearest_root
from loomgraph.operators.source_text import line_count
from loomgraph.plans.store import TABLES, CodeStore, new_snapshot
from loomgraph.schema import FILE_STATE, conform
from loomgraph.session import scratch_folder
from loomgraph.sources.tables import language_suffix, table

EXT_SQL = """case lang when 'en' then '.py' when 'fr' then '.ts' when 'de' then '.js'
             when 'es' then '.tsx' else '.txt' end"""

LISTING_SQL = f"""
    placed as (
        select source as repo_id, encode(text) as content, strlen(text) as size,
            ['src', 'lib/node_modules', 'app/migrations', 'build', 'docs/api', 'web/public', 'gen'][(doc_id % 7 + 1)::int]
            || '/doc_' || doc_id || case when doc_id % 11 = 3 then '.min' else '' end || {EXT_SQL} as relative_path
        from documents),
    sources as (select distinct source as repo_id from documents),
    markers as (
        select repo_id, 'manage.py' as relative_path, 'import django' as body from sources where repo_id like '%1'
        union all select repo_id, 'web/package.json', '{{"dependencies": {{"react": "18"}}}}' from sources where repo_id like '%2'
        union all select repo_id, 'app.py', 'from Flask import Flask' from sources where repo_id like '%3'
        union all select repo_id, '.gitignore', 'docs/
/gen/doc_*[05].*
!gen/*5.py' from sources where repo_id like '%4'
        union all select repo_id, 'node_modules/manage.py', 'x' from sources),
    listing as (select repo_id, relative_path, size, content from placed
        union all select repo_id, relative_path, strlen(body), encode(body) from markers)"""


def corpus_listing(spark, folder) -> DataFrame:
    """Documents as files of one repository per source, plus marker files per source."""
    docs = table(spark, folder, "documents")
    dirs = ["src", "lib/node_modules", "app/migrations", "build", "docs/api", "web/public", "gen"]
    directory = F.element_at(
        F.array(*[F.lit(d) for d in dirs]), (F.col("doc_id") % 7 + 1).cast("int")
    )
    small = F.when(F.col("doc_id") % 11 == 3, ".min").otherwise("")
    placed = docs.select(
        F.col("source").alias("repo_id"),
        F.concat(
            directory, F.lit("/doc_"), F.col("doc_id").cast("string"), small, language_suffix(F.col("lang"))
        ).alias("relative_path"),
        F.encode("text", "UTF-8").alias("content"),
    )
    marks = [
        ("%1", "manage.py", "import django"),
        ("%2", "web/package.json", '{"dependencies": {"react": "18"}}'),
        ("%3", "app.py", "from Flask import Flask"),
        ("%4", ".gitignore", "docs/\n/gen/doc_*[05].*\n!gen/*5.py"),
        ("%", "node_modules/manage.py", "x"),
    ]
    marker = F.explode(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col("repo_id").like(like),
                        F.struct(F.lit(path).alias("relative_path"), F.encode(F.lit(body), "UTF-8").alias("content")),
                    )
                    for like, path, body in marks
                ]
            )
        )
    )
    markers = docs.select(F.col("source").alias("repo_id")).distinct().select("repo_id", marker.alias("m"))
    return (
        placed.unionByName(markers.select("repo_id", "m.*"))
        .withColumn("path", F.concat_ws("/", F.lit(""), "repo_id", "relative_path"))
        .withColumn("size", F.octet_length("content").cast("bigint"))
    )


FRAMEWORKS_SQL = """
    fw as (
        select repo_id, 'django' as f from listing where relative_path = 'manage.py'
        union select repo_id, 'node' from listing where relative_path = 'web/package.json'
        union select repo_id, 'react' from listing where relative_path = 'web/package.json'
        union select repo_id, 'flask' from listing where relative_path = 'app.py')"""


@query(
    "detect_frameworks",
    f"with {LISTING_SQL}, {FRAMEWORKS_SQL} select repo_id, list(f order by f) as frameworks from fw group by repo_id",
)
def detect_frameworks(spark, folder):
    return discovery.detect_frameworks(corpus_listing(spark, folder))


HEAD_SQL = """
    regexp_replace(hex(content), '(..)', '\\1 ', 'g') as head"""
MINIFIED_SQL = """
    (length(head) // 3 - 0) as bytes, (length(head) - length(replace(head, '0A ', ''))) // 3 + 1 as lines"""
IS_MINIFIED = "((lines <= 1 and bytes > 1000) or bytes / lines > 500)"


@query(
    "discover_filter",
    f"""with {LISTING_SQL}, {FRAMEWORKS_SQL},
    h as (select *, {HEAD_SQL} from listing), m as (select *, {MINIFIED_SQL} from h),
    kept as (select * from m
        where relative_path similar to '.*\\.(py|ts|tsx|js|jsx)' and size <= 24 * 1024
          and not relative_path like '%.min.js' and not {IS_MINIFIED}
          and not list_has_any(string_split(relative_path, '/'), ['node_modules', 'build'])
          and not (relative_path like '%/migrations/%' and repo_id in (select repo_id from fw where f in ('django', 'flask')))
          and not (relative_path like '%/public/%' and repo_id in (select repo_id from fw where f = 'react'))
          and not (repo_id like '%4' and (relative_path like 'docs/%'
               or (relative_path similar to 'gen/doc_.*[05]\\..*' and not relative_path like 'gen/%5.py'))))
    select repo_id, relative_path, case regexp_extract(relative_path, '\\.[a-z]+$')
        when '.py' then 'python' when '.ts' then 'typescript' when '.tsx' then 'tsx' else 'javascript' end as language,
        size::bigint as size from kept""",
)
def discover_filter(spark, folder):
    """All discovery predicates with a limit of 24 KB per file."""
    found = discovery.discover(corpus_listing(spark, folder), max_file_size_kb=24)
    return found.select("repo_id", "relative_path", "language", "size")


@query(
    "minified_flag",
    f"""with {LISTING_SQL}, h as (select *, {HEAD_SQL} from listing), m as (select *, {MINIFIED_SQL} from h)
    select repo_id, relative_path, {IS_MINIFIED} or relative_path like '%.min.js' as minified from m""",
)
def minified_flag(spark, folder):
    listing = corpus_listing(spark, folder)
    flag = discovery.is_minified(F.col("relative_path"), F.col("content"))
    return listing.select("repo_id", "relative_path", flag.alias("minified"))


@query(
    "ext_language_map",
    f"""with {LISTING_SQL}
    select relative_path, case when relative_path like '%.py' then 'python' when relative_path like '%.ts' then 'typescript'
        when relative_path like '%.tsx' then 'tsx' when relative_path like '%.js' then 'javascript' end as language,
        relative_path similar to '.*\\.(py|ts|tsx|js)' as indexable from placed""",
)
def ext_language_map(spark, folder):
    path = F.col("relative_path")
    files = corpus_listing(spark, folder).filter(file_name(path).like("doc\\_%"))
    return files.select("relative_path", language_of(path).alias("language"), is_indexable(path).alias("indexable"))


@query("content_hash", "select doc_id, sha256(text) as content_hash from documents")
def content_hash(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


@query("repo_id_hash", "select page_id, sha256(url)[1:16] as repo_id from pages")
def repo_id_hash(spark, folder):
    return table(spark, folder, "pages").select("page_id", repo_id_of(F.col("url")).alias("repo_id"))


@query(
    "line_count",
    "select doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::int as line_count from documents",
)
def count_lines(spark, folder):
    return table(spark, folder, "documents").select("doc_id", line_count(F.col("text")).alias("line_count"))


# --- snapshots: documents now, the labelled documents and the pages as stored before ---

SNAPSHOT_SQL = f"""
    cur as (select source as repo_id, doc_id || {EXT_SQL} as file_path, sha256(text) as content_hash from documents),
    old as (
        select d.source as repo_id, d.doc_id || {EXT_SQL} as file_path,
            case when l.quality = 1 then sha256(d.text) else sha256('old ' || d.text) end as content_hash,
            lang as language, n_chars as entity_count
        from documents d join labels l using (doc_id)
        union all
        select 'src' || page_id % 20, 'page_' || page_id || '.py', sha256(html), 'en', 1 from pages)"""


def _current(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select(
        F.col("source").alias("repo_id"),
        F.concat(F.col("doc_id").cast("string"), language_suffix(F.col("lang"))).alias("file_path"),
        F.sha2("text", 256).alias("content_hash"),
    )


def _stored(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    before = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.concat(F.lit("old "), "text"))
    labelled = docs.select(
        F.col("source").alias("repo_id"),
        F.concat(F.col("doc_id").cast("string"), language_suffix(F.col("lang"))).alias("file_path"),
        F.sha2(before, 256).alias("content_hash"),
        F.col("lang").alias("language"),
        F.col("n_chars").alias("entity_count"),
    )
    pages = table(spark, folder, "pages").select(
        F.concat(F.lit("src"), (F.col("page_id") % 20).cast("string")).alias("repo_id"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".py")).alias("file_path"),
        F.sha2("html", 256).alias("content_hash"),
        F.lit("en").alias("language"),
        F.lit(1).cast("bigint").alias("entity_count"),
    )
    return labelled.unionByName(pages)


DIFF_SQL = """
    d as (
        select coalesce(c.repo_id, o.repo_id) as repo_id, coalesce(c.file_path, o.file_path) as file_path,
            case when o.content_hash is null then 'new' when c.content_hash is null then 'deleted'
                 when c.content_hash <> o.content_hash then 'changed' else 'unchanged' end as status
        from cur c full outer join old o on c.repo_id = o.repo_id and c.file_path = o.file_path)"""


@query("snapshot_diff", f"with {SNAPSHOT_SQL}, {DIFF_SQL} select * from d")
def snapshot_diff(spark, folder):
    found = snapshots.diff(_current(spark, folder), _stored(spark, folder))
    return found.select("repo_id", "file_path", "status")


@query(
    "snapshot_new",
    f"""with {SNAPSHOT_SQL} select * from cur c
    where not exists (select 1 from old o where o.repo_id = c.repo_id and o.file_path = c.file_path)""",
)
def snapshot_new(spark, folder):
    return snapshots.only_new(_current(spark, folder), _stored(spark, folder))


@query(
    "snapshot_deleted",
    f"""with {SNAPSHOT_SQL} select repo_id, file_path, content_hash from old o
    where not exists (select 1 from cur c where o.repo_id = c.repo_id and o.file_path = c.file_path)""",
)
def snapshot_deleted(spark, folder):
    gone = snapshots.only_deleted(_current(spark, folder), _stored(spark, folder))
    return gone.select("repo_id", "file_path", "content_hash")


@query(
    "snapshot_common",
    f"""with {SNAPSHOT_SQL} select * from cur c
    where exists (select 1 from old o where o.repo_id = c.repo_id and o.file_path = c.file_path)""",
)
def snapshot_common(spark, folder):
    return snapshots.in_both(_current(spark, folder), _stored(spark, folder))


COUNTERS_SQL = ", ".join(
    f"count(*) filter (status = '{s}') as {s}_files" for s in ("new", "changed", "deleted", "unchanged", "skipped")
)


@query(
    "snapshot_counters",
    f"with {SNAPSHOT_SQL}, {DIFF_SQL} select repo_id, {COUNTERS_SQL} from d group by repo_id",
)
def snapshot_counters(spark, folder):
    return snapshots.counters(snapshots.diff(_current(spark, folder), _stored(spark, folder)))


def _refreshed_store(spark, folder) -> CodeStore:
    """A store with a first snapshot of the labelled documents and pages, refreshed to all documents.

    Every file has one node, whose id is the file's hash and whose line_count the run's number.
    """
    store = CodeStore(spark, scratch_folder(spark), buckets=2)

    def commit(snapshot: str, run: int, files: DataFrame, gone: DataFrame) -> None:
        nodes = files.select("repo_id", "file_path", F.col("content_hash").alias("id"), F.lit(run).alias("line_count"))
        store.write_snapshot("nodes", conform(nodes, TABLES["nodes"]), snapshot)
        fresh = files.withColumns({"deleted": F.lit(False), "data_snapshot": F.lit(snapshot)})
        state = conform(fresh, FILE_STATE).unionByName(conform(gone.withColumn("deleted", F.lit(True)), FILE_STATE))
        store.write_snapshot("file_state", state, snapshot)
        row = state.groupBy("repo_id").agg(F.collect_set(store.bucket()).alias("buckets"))
        row = row.withColumns({"snapshot": F.lit(snapshot), "kind": F.lit("delta"), "indexed_at": F.current_timestamp()})
        store.append("repo_state", conform(row, TABLES["repo_state"]))

    stored = _stored(spark, folder)
    commit(new_snapshot(), 1, stored.select("repo_id", "file_path", "content_hash"), stored.filter("false"))
    differences = snapshots.diff(_current(spark, folder), store.current("file_state"))
    touched = differences.filter("status in ('new', 'changed')").withColumn("content_hash", F.col("new_hash"))
    commit(new_snapshot(), 2, touched, differences.filter("status = 'deleted'"))
    return store


REFRESHED_SQL = f"""with {SNAPSHOT_SQL}, {DIFF_SQL}
    select cur.repo_id, cur.file_path, cur.content_hash as id, case status when 'unchanged' then 1 else 2 end as run
    from cur join d using (repo_id, file_path)"""


@query("store_refresh", REFRESHED_SQL)
def store_refresh(spark, folder):
    """Nodes as readers see them after a refresh that wrote the changed files only."""
    return _refreshed_store(spark, folder).current("nodes").select("repo_id", "file_path", "id", F.col("line_count").alias("run"))


@query("store_compacted", REFRESHED_SQL)
def store_compacted(spark, folder):
    """The same nodes once crowded buckets are rewritten and what they hid is removed."""
    store = _refreshed_store(spark, folder)
    store.compact(store.crowded(1))
    store.vacuum(0)
    return store.current("nodes").select("repo_id", "file_path", "id", F.col("line_count").alias("run"))


@query(
    "stale_report",
    f"""with {SNAPSHOT_SQL}, {DIFF_SQL},
    t as (select repo_id, count(*) filter (status <> 'unchanged') as stale_count,
            count(*) filter (status <> 'new') as total_indexed,
            (list(file_path order by case status when 'changed' then 0 when 'new' then 1 else 2 end, file_path)
                filter (status <> 'unchanged'))[1:5] as preview
          from d group by repo_id)
    select repo_id, stale_count, total_indexed, stale_count > 0 or total_indexed = 0 as is_stale, preview from t""",
)
def stale_report(spark, folder):
    found = snapshots.staleness(snapshots.diff(_current(spark, folder), _stored(spark, folder)))
    return found.select("repo_id", "stale_count", "total_indexed", "is_stale", "preview")


DIGEST_SQL = """
    {name}_f as (select repo_id, file_path, string_split(file_path, '/') as parts,
            ('0x' || substr(md5(file_path || chr(31) || {fact}), 1, 15))::bigint as h from {source}),
    {name}_d as (select repo_id, n - 1 as depth, array_to_string(parts[1 : n - 1], '/') as directory, h
            from (select repo_id, parts, h, unnest(range(1, len(parts) + 1)) as n from {name}_f)),
    {name} as (select repo_id, directory, depth::int as depth, count(*) as files, bit_xor(h) as digest from {name}_d group by all)"""


@query(
    "directory_digests",
    f"with {LISTING_SQL}, named as (select repo_id, relative_path as file_path, size from listing), "
    f"{DIGEST_SQL.format(name='t', source='named', fact='size')} select * from t",
)
def directory_digests(spark, folder):
    """Digest of every directory of the corpus as source trees, by path and size."""
    files = corpus_listing(spark, folder).withColumnRenamed("relative_path", "file_path")
    return digests.directory_digests(files, "size")


def _nested(files: DataFrame) -> DataFrame:
    """File paths dealt over two levels of directories by the last digits of their number."""
    number = F.regexp_extract("file_path", r"(\d+)\.", 1)
    path = F.concat(F.lit("d"), F.right(number, F.lit(1)), F.lit("/e"), F.right(number, F.lit(2)), F.lit("/"), "file_path")
    return files.select("repo_id", path.alias("file_path"), "content_hash")


NESTED_SQL = """
    {name}_n as (select repo_id, 'd' || right(x, 1) || '/e' || right(x, 2) || '/' || file_path as file_path, content_hash
            from (select *, regexp_extract(file_path, '(\\d+)\\.', 1) as x from {source}))"""


@query(
    "changed_directories",
    f"""with {SNAPSHOT_SQL}, {NESTED_SQL.format(name='c', source='cur')}, {NESTED_SQL.format(name='o', source='old')},
    {DIGEST_SQL.format(name='now', source='c_n', fact='content_hash')}, {DIGEST_SQL.format(name='was', source='o_n', fact='content_hash')},
    u as (select coalesce(a.repo_id, b.repo_id) as repo_id, coalesce(a.directory, b.directory) as directory, coalesce(a.depth, b.depth) as depth
          from now a full outer join was b on a.repo_id = b.repo_id and a.directory = b.directory
          where a.files is distinct from b.files or a.digest is distinct from b.digest)
    select * from u where not exists (select 1 from u below where below.repo_id = u.repo_id and below.depth = u.depth + 1
        and (u.depth = 0 or starts_with(below.directory, u.directory || '/')))""",
)
def changed_directories(spark, folder):
    """The deepest directories that differ between the labelled documents and all of them."""
    now = digests.directory_digests(_nested(_current(spark, folder)), "content_hash")
    before = digests.directory_digests(_nested(_stored(spark, folder)), "content_hash")
    return digests.changed_directories(now, before)


@query(
    "language_counts",
    f"with {SNAPSHOT_SQL} select repo_id, language, count(*) as files from old group by all",
)
def language_counts(spark, folder):
    return snapshots.language_counts(_stored(spark, folder))


@query(
    "repo_totals",
    f"""with {SNAPSHOT_SQL} select repo_id, count(*) as total_files, sum(entity_count)::bigint as total_entities
    from old group by repo_id""",
)
def repo_totals(spark, folder):
    state = _stored(spark, folder).withColumn("last_indexed_at", F.lit(None).cast("timestamp"))
    return snapshots.repo_totals(state).drop("last_indexed_at")


@query(
    "nearest_indexed_root",
    """
    with p as (select distinct url as path, string_split(url, '/') as parts from pages),
    roots as (
        select distinct array_to_string(parts[1:3], '/') as root from p where url_host(parts) like '%.org'
        union select distinct array_to_string(parts[1:4], '/') from p where length(parts) > 4)
    select p.path, arg_max(r.root, length(r.root)) as root
    from p left join roots r on p.path = r.root or starts_with(p.path, r.root || '/') group by p.path
    """.replace("url_host(parts)", "parts[3]"),
)
def nearest_indexed_root(spark, folder):
    """Deepest indexed folder above each page address."""
    pages = table(spark, folder, "pages").select(F.col("url").alias("path"))
    parts = F.split("path", "/")
    head = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    roots = (
        pages.filter(F.element_at(parts, 3).like("%.org")).select(head(3).alias("root"))
        .unionByName(pages.filter(F.size(parts) > 4).select(head(4).alias("root")))
        .distinct()
    )
    return nearest_root(pages, roots)
