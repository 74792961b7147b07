"""From parsed entities to typed nodes and edges.

Linking never leaves a file, so every group below lies in one file and one exchange on
the file serves all of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.operators.containment import with_enclosing
from loomgraph.operators.python_source import python_entities
from loomgraph.operators.script_source import script_entities
from loomgraph.operators.source_text import FILE_KEY, line_count
from loomgraph.schema import EDGES, ENTITIES, NODES, conform

SCRIPT_LANGUAGES = ("javascript", "typescript", "tsx")
FUNCTION_KINDS = ("function", "arrow", "method", "generator")
CLASS_KINDS = ("class", "interface", "type_alias")
_SUMMARY_MODULES = 10


def parse_files(files: DataFrame, outline: bool = False) -> DataFrame:
    """Entity rows of source files (``repo_id, file_path, language, text``).

    Calls are distinct by target in a file; the first call site stays. An ``outline`` has the
    same rows but calls, with names, places, owners, modules, and the statements of imports;
    headers and texts of definitions are null. It shuffles nothing after the files.
    """
    python = files.filter(F.col("language") == "python")
    script = files.filter(F.col("language").isin(*SCRIPT_LANGUAGES))
    if outline:
        return python_entities(python, outline).unionByName(script_entities(script, outline))
    return _distinct_calls(python_entities(python).unionByName(script_entities(script)))


def _by_file(entities: DataFrame) -> DataFrame:
    """A file's rows in one task: windows over parts of a file then shuffle nothing. Rows that lie so already stay."""
    return entities.repartition(*FILE_KEY)


def _distinct_calls(entities: DataFrame) -> DataFrame:
    # Python and scripts under one path are two files.
    first = Window.partitionBy(*FILE_KEY, F.col("language") == "python", "kind", "call_target").orderBy("ordinal")
    return (
        _by_file(entities).withColumn("_n", F.row_number().over(first))
        .filter((F.col("kind") != "call") | (F.col("_n") == 1))
        .drop("_n")
    )


def entity_rows(entities: DataFrame) -> DataFrame:
    return conform(entities, ENTITIES)


def file_summaries(entities: DataFrame) -> DataFrame:
    """Structural summary text per file: names by kind, first ten distinct modules."""
    in_order = lambda kinds, value: F.transform(
        F.sort_array(
            F.collect_list(
                F.when(F.col("kind").isin(*kinds), F.struct("ordinal", F.col(value).alias("v")))
            )
        ),
        lambda e: e["v"],
    )
    sections = (
        ("Classes", ("class",), "name"),
        ("Interfaces", ("interface",), "name"),
        ("Types", ("type_alias",), "name"),
        ("Functions", ("function", "arrow"), "name"),
        ("Methods", ("method",), "name"),
        ("Imports from", ("import",), "source_module"),
        ("Exports", ("export",), "name"),
    )
    listed = entities.groupBy(*FILE_KEY).agg(
        *[in_order(kinds, value).alias(title) for title, kinds, value in sections]
    )

    def section(title: str) -> Column:
        names = F.col(f"`{title}`")
        present = F.size(names) > 0
        if title == "Imports from":
            names = F.slice(F.array_distinct(names), 1, _SUMMARY_MODULES)
        if title == "Exports":
            names = F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")
        return F.when(present, F.concat(F.lit(title + ": "), F.array_join(names, ", ")))

    text = F.concat_ws("; ", *[section(title) for title, _, _ in sections])
    return listed.select(
        *FILE_KEY, F.when(text == "", "Empty file").otherwise(text).alias("summary")
    )


def _node_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\u0001", *parts), 256), 1, 32)


def _file_id() -> Column:
    return _node_id(F.col("repo_id"), F.col("file_path"), F.lit("CodeFile"))


def symbols(entities: DataFrame) -> DataFrame:
    """Entities that become nodes, with node type, qualified name and a stable id.

    Ids derive from content position, so indexing a file again yields the same ids.
    """
    kind = F.col("kind")
    node_type = (
        F.when(kind.isin(*FUNCTION_KINDS), "CodeFunction")
        .when(kind.isin(*CLASS_KINDS), "CodeClass")
        .when(kind == "import", "CodeImport")
        .when(kind == "export", "CodeExport")
        .when(kind == "variable", "CodeVariable")
    )
    qualified = F.concat_ws(".", "parent_name", "name")
    return (
        entities.withColumn("type", node_type)
        .withColumn("qualified_name", F.when(node_type == "CodeFunction", qualified))
        .withColumn(
            "id",
            F.when(
                node_type.isNotNull(),
                _node_id(
                    F.col("repo_id"), F.col("file_path"), node_type, qualified,
                    F.col("start_line").cast("string"), F.col("ordinal").cast("string"),
                ),
            ),
        )
    )


def build_nodes(files: DataFrame, entities: DataFrame) -> DataFrame:
    """One node per file and per definition, import, export and variable."""
    of_files = (
        files.select(*FILE_KEY, "language", line_count(F.col("text")).alias("line_count"))
        .join(file_summaries(entities), FILE_KEY, "left")
        .select(
            _file_id().alias("id"), *FILE_KEY, F.lit("CodeFile").alias("type"), "language",
            "line_count", F.coalesce("summary", F.lit("Empty file")).alias("summary"),
        )
    )
    kind, node_type = F.col("kind"), F.col("type")
    is_import = node_type == "CodeImport"
    of_symbols = symbols(entities).filter("type is not null")
    of_symbols = (
        of_symbols.withColumn("import_statement", F.when(is_import, F.col("signature")))
        .withColumn("source_module", F.when(is_import, F.coalesce("source_module", "name")))
        .withColumn("name", F.when(~is_import, F.col("name")))
        .withColumn(
            "kind",
            F.when(node_type == "CodeVariable", "const")
            .when(node_type == "CodeExport", F.coalesce("export_kind", F.lit("named")))
            .when(~is_import, kind),
        )
        .withColumn(
            "signature", F.when(node_type.isin("CodeFunction", "CodeClass"), F.col("signature"))
        )
        .withColumn(
            "docstring", F.when(node_type.isin("CodeFunction", "CodeClass"), F.col("docstring"))
        )
        .drop("language")
    )
    return conform(of_files, NODES).unionByName(conform(of_symbols, NODES))


def build_edges(entities: DataFrame) -> DataFrame:
    """All relationships of a file's symbols.

    Names resolve through windows over (file, key): the last definition of a key
    wins. A reference row reads the definitions of its key without any join.
    """
    known = symbols(_by_file(entities))
    file_id = _file_id()
    node_type, kind = F.col("type"), F.col("kind")

    def edge(source: Column, target: Column, name: str) -> Column:
        return F.struct(
            source.alias("from_id"), target.alias("to_id"), F.lit(name).alias("relationship_name")
        )

    # Functions and classes repeated under one key: only the last is a symbol of its file.
    key = F.when(node_type == "CodeFunction", F.col("qualified_name")).when(
        node_type == "CodeClass", F.col("name")
    )
    last_of_key = Window.partitionBy(*FILE_KEY, "type", "_key").orderBy(F.col("ordinal").desc())
    keyed = known.withColumn("_key", key).withColumn("_last", F.row_number().over(last_of_key) == 1)
    owns = F.when(
        (node_type == "CodeVariable")
        | (node_type.isin("CodeFunction", "CodeClass") & F.col("_last")),
        edge(file_id, F.col("id"), "contains_symbols"),
    )
    own_edges = F.array(
        owns,
        F.when(node_type == "CodeImport", edge(file_id, F.col("id"), "imports")),
        F.when(node_type == "CodeExport", edge(file_id, F.col("id"), "exports")),
        F.when(
            (node_type.isin("CodeFunction", "CodeClass") & (kind != "method"))
            | (node_type == "CodeVariable"),
            edge(F.col("id"), file_id, "defined_in"),
        ),
    )

    # Every call with the function around it: the first of the file's functions that spans it.
    callers = _callers(keyed)

    # Rows that define a key, and rows that refer to one.
    definition = F.struct("id", "ordinal", "type")
    none = F.lit(None).cast("string")

    def row(name: Column, rank: int, definer: Column, relation: Column, origin: Column) -> Column:
        return F.struct(
            name.alias("ref"), F.lit(rank).alias("rank"), definer.alias("definition"),
            relation.alias("relation"), origin.alias("origin"),
        )

    no_definition = F.lit(None).cast("struct<id:string,ordinal:bigint,type:string>")
    defines = F.when(
        node_type.isin("CodeFunction", "CodeClass"),
        F.array(row(F.concat_ws(":", "type", "_key"), 0, definition, none, none)),
    )
    refer = lambda name, relation, origin: row(name, 1, no_definition, F.lit(relation), origin)
    fn, cls = F.lit("CodeFunction:"), F.lit("CodeClass:")
    bases = base_names(F.col("bases"), ",")
    empty = "array<struct<ref:string,rank:int,definition:struct<id:string,ordinal:bigint,type:string>,relation:string,origin:string>>"
    references = F.concat(
        F.coalesce(defines.cast(empty), F.array().cast(empty)),
        F.when(
            kind == "call",
            F.array(refer(F.concat(fn, "call_target"), "calls", F.col("_caller"))).cast(empty),
        ).otherwise(F.array().cast(empty)),
        F.when(
            (kind == "method") & F.col("_last") & F.col("parent_name").isNotNull(),
            F.array(refer(F.concat(cls, "parent_name"), "methods", F.col("id"))).cast(empty),
        ).otherwise(F.array().cast(empty)),
        F.when(
            (kind == "class") & F.col("bases").isNotNull(),
            F.transform(
                bases, lambda b: refer(F.concat(cls, b), "inherits_from", F.col("_last_id"))
            ).cast(empty),
        ).otherwise(F.array().cast(empty)),
        F.when(
            kind == "export",
            F.array(
                refer(F.concat(fn, "name"), "exports_function", F.col("id")),
                refer(F.concat(cls, "name"), "exports_class", F.col("id")),
            ).cast(empty),
        ).otherwise(F.array().cast(empty)),
    )
    whole_key = (
        Window.partitionBy(*FILE_KEY, "type", "_key")
        .orderBy("ordinal")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    prepared = callers.withColumn("_last_id", F.last("id").over(whole_key))
    no_refs = F.array().cast("array<struct<from_id:string,to_id:string,relationship_name:string>>")
    exploded = prepared.select(
        *FILE_KEY,
        F.posexplode(
            F.concat(
                F.array(F.struct(own_edges.alias("own"), F.lit(None).cast(_item(empty)).alias("r"))),
                F.transform(
                    references,
                    lambda r: F.struct(no_refs.alias("own"), r.alias("r")),
                ),
            )
        ).alias("_n", "_x"),
    )
    by_ref = (
        Window.partitionBy(*FILE_KEY, "_ref")
        .orderBy("_rank", "_at")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    resolved = (
        exploded.withColumn("_ref", F.col("_x.r.ref"))
        .withColumn("_rank", F.col("_x.r.rank"))
        .withColumn("_at", F.col("_x.r.definition.ordinal"))
        .withColumn("_target", F.last("_x.r.definition", ignorenulls=True).over(by_ref))
    )
    relation, origin, target = F.col("_x.r.relation"), F.col("_x.r.origin"), F.col("_target.id")
    # An export that names both a function and a class points at the function.
    by_export = Window.partitionBy(*FILE_KEY, F.col("_x.r.origin"))
    has_function = F.max(
        ((relation == "exports_function") & target.isNotNull()).cast("int")
    ).over(by_export)
    resolved = resolved.withColumn("_fn", has_function)
    linked = F.when(
        target.isNotNull() & origin.isNotNull(),
        F.when(
            (relation == "calls") & (origin != target), F.array(edge(origin, target, "calls"))
        )
        .when(
            relation == "methods",
            F.array(edge(target, origin, "methods"), edge(origin, target, "defined_in")),
        )
        .when(relation == "inherits_from", F.array(edge(origin, target, "inherits_from")))
        .when(
            (relation == "exports_function") | ((relation == "exports_class") & (F.col("_fn") == 0)),
            F.array(edge(origin, target, "exports_symbol")),
        ),
    )
    edges = resolved.select(
        *FILE_KEY, F.explode(F.coalesce(linked, F.col("_x.own"))).alias("_e")
    ).filter("_e is not null")
    return conform(edges.select(*FILE_KEY, "_e.*").distinct(), EDGES)


def base_names(text: Column, separator: str) -> Column:
    """The names of a list of base classes, without brackets around it; empty ones left out."""
    named = F.transform(F.split(text, separator), lambda b: F.btrim(F.trim(b), F.lit("()")))
    return F.filter(named, lambda b: b != "")


def _item(array_type: str) -> str:
    return array_type[len("array<") : -1]


def _callers(keyed: DataFrame) -> DataFrame:
    """Adds ``_caller``: the node a call belongs to (null for other rows).

    Among the functions spanning a call the first in file order counts: plain
    functions before arrow functions before methods in scripts, source order in
    Python. In each of these classes that is the outermost one.
    """
    kind = F.col("kind")
    spanning = kind.isin("function", "arrow", "method")
    ranks = F.when(kind == "call", F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(
        F.array("call_rank")
    )
    latest = (
        Window.partitionBy(*FILE_KEY, "type", "_key")
        .orderBy("ordinal")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    spread = keyed.withColumn("_latest_id", F.last("id").over(latest)).withColumn(
        "_class", F.explode(ranks)
    )
    around = with_enclosing(
        spread, [*FILE_KEY, "_class"], "start_line", "end_line", spanning,
        ["ordinal"], ["_latest_id"], "_around", outermost=True,
    )
    call = Window.partitionBy(*FILE_KEY, "kind", "ordinal").orderBy("_class")
    first = F.first(F.col("_around._latest_id"), ignorenulls=True).over(
        call.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return (
        around.withColumn("_caller", F.when(kind == "call", first))
        .filter((kind != "call") | (F.col("_class") == 0))
        .drop("_class", "_around", "_latest_id")
    )
