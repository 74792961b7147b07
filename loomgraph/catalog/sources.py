"""Parsing and graph building over source modules written from the part table.

Each part becomes one Python and one TypeScript module whose classes, methods,
helpers and calls follow from the part's columns, so SQL over the same table
states what extraction has to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.catalog.registry import query
from loomgraph.operators import code_graph
from loomgraph.operators.containment import with_enclosing
from loomgraph.session import materialised, partitions_for
from loomgraph.sources.tables import spread, table


def _text(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def _joined(head: list, block, tail: list, block_after) -> Column:
    """Lines joined to a module: head, one block per step, tail, one block per step."""
    steps = F.sequence(F.lit(1), F.expr("int((p_size + 9) div 10)"))
    as_lines = lambda items: F.array(*[_text(x) if not isinstance(x, Column) else x for x in items])
    repeated = lambda make: F.flatten(F.transform(steps, lambda i: as_lines(make(i.cast("string")))))
    return F.array_join(
        F.concat(as_lines(head), repeated(block), as_lines(tail), repeated(block_after)), "\n"
    )


def part_modules(spark, folder) -> DataFrame:
    """Source files (repo_id, file_path, language, text) derived row by row: a repository per brand."""
    part = spread(table(spark, folder, "part"))
    key, size, name, kind = (
        F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_name"), F.col("p_type"),
    )
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))
    python = _joined(
        [
            _text('"""Catalogue entry ', key, '."""'),
            "import region, nation",
            _text("from .brands.", brand, " import Brand as Maker, price"),
            "",
            _text("SIZE: int = ", size),
            _text('LABEL = "', name, ' (not a call(x))"'),
            "",
            "class Base:",
            "    pass",
            "",
            _text("class Part", key, "(Base):"),
            _text('    """', kind, ' part."""'),
            "",
        ],
        lambda i: [
            _text("    def step_", i, "(self, qty: int = ", i, ") -> float:"),
            _text('        """Step ', i, " of ", name, '."""'),
            _text("        return helper_", i, "(qty) * scale(qty)"),
            "",
        ],
        ["def scale(qty):", "    return qty", ""],
        lambda i: [
            _text("def helper_", i, "(qty):"),
            F.when(i == "1", "    return scale(qty)").otherwise(
                _text("    return helper_", (i.cast("int") - 1).cast("string"), "(qty)")
            ),
            "",
        ],
    )
    script = _joined(
        [
            _text('import Maker, { Brand, price as cost } from "./brands/', brand, '";'),
            "import * as region from './region';",
            'export { nation } from "./nation";',
            "",
            _text("export interface Row", key, " {"),
            "  qty: number;",
            "}",
            "",
            _text("export type Label", key, ' = "', name, "\" | 'none';"),
            _text("const SIZE: number = ", size, ";"),
            "",
            _text("/** ", kind, " part (not a call). */"),
            _text("export class Part", key, " extends Base {"),
        ],
        lambda i: [
            _text("  step", i, "(qty: number): number {"),
            _text("    return helper", i, "(qty) * scale(qty);"),
            "  }",
        ],
        ["}", "", "export function scale(qty: number): number {", "  return qty;", "}"],
        lambda i: [
            _text("export const helper", i, " = (qty: number): number => {"),
            _text("  return scale(qty) + ", i, ";"),
            "};",
        ],
    )
    return part.select(
        brand.alias("repo_id"),
        F.explode(
            F.array(
                F.struct(
                    _text("py/part_", key, ".py").alias("file_path"),
                    F.lit("python").alias("language"), python.alias("text"),
                ),
                F.struct(
                    _text("ts/part_", key, ".ts").alias("file_path"),
                    F.lit("typescript").alias("language"), script.alias("text"),
                ),
            )
        ).alias("_f"),
    ).select("repo_id", "_f.*")


# One row per entity a Python module contains; the columns are those of ENTITY_COLUMNS.
_COLUMNS = (
    "file_path, kind, name, start_line, end_line, parent_name, bases, signature, docstring, "
    "parameters, return_type, source_module, imported_names, export_kind, call_target, type_annotation"
)

PARTS_SQL = """
    p as (select *, (p_size + 9) // 10 as n, lower(replace(p_brand, '#', '_')) as brand,
            'py/part_' || p_partkey || '.py' as py, 'ts/part_' || p_partkey || '.ts' as ts from part),
    steps as (select *, unnest(range(1, n + 1)) as i from p)"""


def _row(source: str, path: str, kind: str, name: str, start: str, end: str, **more: str) -> str:
    values = {c.strip(): "null" for c in _COLUMNS.split(",")}
    values.update(
        file_path=path, kind=f"'{kind}'", name=name, start_line=start, end_line=end,
        imported_names="''", signature="''",
    )
    values.update(more)
    return "select " + ", ".join(f"{v} as {c}" for c, v in values.items()) + f" from {source}"


_PY_ROWS = [
    _row("p", "py", "import", "'region'", "2", "2", signature="'import region, nation'", source_module="'region'"),
    _row("p", "py", "import", "'nation'", "2", "2", signature="'import region, nation'", source_module="'nation'"),
    _row("p", "py", "import", "'.brands.' || brand", "3", "3",
         signature="'from .brands.' || brand || ' import Brand as Maker, price'",
         source_module="'.brands.' || brand", imported_names="'Brand,price'"),
    _row("p", "py", "variable", "'SIZE'", "5", "5", signature="'SIZE: int = ' || p_size", type_annotation="'int'"),
    _row("p", "py", "variable", "'LABEL'", "6", "6", signature="'LABEL = \"' || p_name || ' (not a call(x))\"'"),
    _row("p", "py", "class", "'Base'", "8", "9", signature="'class Base:' || chr(10) || '    pass'"),
    _row("p", "py", "class", "'Part' || p_partkey", "11", "12 + 4 * n", bases="'(Base)'",
         signature="'class Part' || p_partkey || '(Base):' || chr(10) || '    \"\"\"' || p_type || ' part.\"\"\" ...'",
         docstring="p_type || ' part.'"),
    _row("steps", "py", "method", "'step_' || i", "10 + 4 * i", "12 + 4 * i",
         parent_name="'Part' || p_partkey",
         signature="""'def step_' || i || '(self, qty: int = ' || i || ') -> float:' || chr(10)
             || '        \"\"\"Step ' || i || ' of ' || p_name || '.\"\"\"' || chr(10)
             || '        return helper_' || i || '(qty) * scale(qty)'""",
         docstring="'Step ' || i || ' of ' || p_name || '.'",
         parameters="'(self, qty: int = ' || i || ')'", return_type="'float'"),
    _row("p", "py", "function", "'scale'", "14 + 4 * n", "15 + 4 * n", parameters="'(qty)'",
         signature="'def scale(qty):' || chr(10) || '    return qty'"),
    _row("steps", "py", "function", "'helper_' || i", "14 + 4 * n + 3 * i", "15 + 4 * n + 3 * i",
         parameters="'(qty)'",
         signature="""'def helper_' || i || '(qty):' || chr(10) || case when i = 1 then '    return scale(qty)'
             else '    return helper_' || (i - 1) || '(qty)' end"""),
    _row("p", "py", "call", "'scale'", "16", "16", call_target="'scale'"),
    _row("steps", "py", "call", "'helper_' || i", "12 + 4 * i", "12 + 4 * i", call_target="'helper_' || i"),
]

_NL = "chr(10)"
_TS_ROWS = [
    _row("p", "ts", "import", "'./brands/' || brand", "1", "1",
         signature="'import Maker, { Brand, price as cost } from \"./brands/' || brand || '\";'",
         source_module="'./brands/' || brand", imported_names="'Brand,price,Maker'"),
    _row("p", "ts", "import", "'./region'", "2", "2",
         signature="'import * as region from ''./region'';'", source_module="'./region'"),
    _row("p", "ts", "export", "'./nation'", "3", "3", signature="'export { nation } from \"./nation\";'",
         source_module="'./nation'", export_kind="'re-export'"),
    _row("p", "ts", "interface", "'Row' || p_partkey", "5", "7",
         signature=f"'interface Row' || p_partkey || ' {{' || {_NL} || '  qty: number;' || {_NL} || '}}'"),
    _row("p", "ts", "export", "'Row' || p_partkey", "5", "7", export_kind="'named'",
         signature=f"'export interface Row' || p_partkey || ' {{' || {_NL} || '  qty: number;' || {_NL} || '}}'"),
    _row("p", "ts", "type_alias", "'Label' || p_partkey", "9", "9",
         signature="'type Label' || p_partkey || ' = \"' || p_name || '\" | ''none'';'"),
    _row("p", "ts", "export", "'Label' || p_partkey", "9", "9", export_kind="'named'",
         signature="'export type Label' || p_partkey || ' = \"' || p_name || '\" | ''none'';'"),
    _row("p", "ts", "variable", "'SIZE'", "10", "10", type_annotation="': number'",
         signature="'const SIZE: number = ' || p_size || ';'"),
    _row("p", "ts", "class", "'Part' || p_partkey", "13", "14 + 3 * n", bases="'Base'",
         docstring="p_type || ' part (not a call).'",
         signature=f"'class Part' || p_partkey || ' extends Base {{' || {_NL} || '  step1(qty: number): number {{' || {_NL} || '    return helper1(qty) * scale(qty); ...'"),
    _row("p", "ts", "export", "'Part' || p_partkey", "13", "14 + 3 * n", export_kind="'named'",
         signature=f"'export class Part' || p_partkey || ' extends Base {{' || {_NL} || '  step1(qty: number): number {{' || {_NL} || '    return helper1(qty) * scale(qty); ...'"),
    _row("steps", "ts", "method", "'step' || i", "11 + 3 * i", "13 + 3 * i", parent_name="'Part' || p_partkey",
         parameters="'(qty: number)'", return_type="': number'",
         signature=f"'step' || i || '(qty: number): number {{' || {_NL} || '    return helper' || i || '(qty) * scale(qty);' || {_NL} || '  }}'"),
    _row("p", "ts", "function", "'scale'", "16 + 3 * n", "18 + 3 * n", parameters="'(qty: number)'", return_type="': number'",
         signature=f"'function scale(qty: number): number {{' || {_NL} || '  return qty;' || {_NL} || '}}'"),
    _row("p", "ts", "export", "'scale'", "16 + 3 * n", "18 + 3 * n", export_kind="'named'",
         signature=f"'export function scale(qty: number): number {{' || {_NL} || '  return qty;' || {_NL} || '}}'"),
    _row("steps", "ts", "arrow", "'helper' || i", "16 + 3 * n + 3 * i", "18 + 3 * n + 3 * i",
         parameters="'(qty: number)'", return_type="': number'",
         signature=f"'const helper' || i || ' = (qty: number): number => {{' || {_NL} || '  return scale(qty) + ' || i || ';' || {_NL} || '}};'"),
    _row("steps", "ts", "export", "'helper' || i", "16 + 3 * n + 3 * i", "18 + 3 * n + 3 * i", export_kind="'named'",
         signature=f"'export const helper' || i || ' = (qty: number): number => {{' || {_NL} || '  return scale(qty) + ' || i || ';' || {_NL} || '}};'"),
    _row("p", "ts", "call", "'scale'", "15", "15", call_target="'scale'"),
    _row("steps", "ts", "call", "'helper' || i", "12 + 3 * i", "12 + 3 * i", call_target="'helper' || i"),
]


def _entities_sql(rows: list[str]) -> str:
    union = " union all ".join(rows)
    return f"""with {PARTS_SQL}, found as ({union})
        select * replace (start_line::int as start_line, end_line::int as end_line,
            parent_name::varchar as parent_name, bases::varchar as bases, docstring::varchar as docstring,
            parameters::varchar as parameters, return_type::varchar as return_type,
            source_module::varchar as source_module, export_kind::varchar as export_kind,
            call_target::varchar as call_target, type_annotation::varchar as type_annotation) from found"""


def _entities(spark, folder, language) -> DataFrame:
    files = part_modules(spark, folder).filter(F.col("language") == language)
    found = code_graph.parse_files(files)
    return found.withColumn("imported_names", F.array_join("imported_names", ",")).select(
        *[c.strip() for c in _COLUMNS.split(",")]
    )


@query("parse_python", _entities_sql(_PY_ROWS))
def parse_python(spark, folder):
    """Entities of one Python module per part."""
    return _entities(spark, folder, "python")


@query("parse_typescript", _entities_sql(_TS_ROWS))
def parse_typescript(spark, folder):
    """Entities of one TypeScript module per part."""
    return _entities(spark, folder, "typescript")


SUMMARY_SQL = """
    summaries as (
        select py as file_path, 16 + 7 * n as line_count,
            'Classes: Base, Part' || p_partkey || '; Functions: scale, '
            || list_aggregate(list_transform(range(1, n + 1), lambda i: 'helper_' || i), 'string_agg', ', ')
            || '; Methods: '
            || list_aggregate(list_transform(range(1, n + 1), lambda i: 'step_' || i), 'string_agg', ', ')
            || '; Imports from: region, nation, .brands.' || brand as summary from p
        union all
        select ts, 18 + 6 * n,
            'Classes: Part' || p_partkey || '; Interfaces: Row' || p_partkey || '; Types: Label' || p_partkey
            || '; Functions: scale, '
            || list_aggregate(list_transform(range(1, n + 1), lambda i: 'helper' || i), 'string_agg', ', ')
            || '; Methods: '
            || list_aggregate(list_transform(range(1, n + 1), lambda i: 'step' || i), 'string_agg', ', ')
            || '; Imports from: ./brands/' || brand || ', ./region; Exports: ./nation, Row' || p_partkey
            || ', Label' || p_partkey || ', Part' || p_partkey || ', scale, '
            || list_aggregate(list_transform(range(1, n + 1), lambda i: 'helper' || i), 'string_agg', ', ') from p)"""


def _graph(spark, folder):
    files = part_modules(spark, folder)
    # Nodes and edges both read the entities: parse once, and let each read the columns it needs.
    return files, materialised(code_graph.parse_files(files))


def _outline_nodes(spark, folder) -> DataFrame:
    """Nodes without headers and texts. The queries over them read either files or symbols, so nothing is parsed twice."""
    files = part_modules(spark, folder)
    return code_graph.build_nodes(files, code_graph.parse_files(files, outline=True))


@query(
    "file_summary_string",
    f"with {PARTS_SQL}, {SUMMARY_SQL} select file_path, line_count::int as line_count, summary from summaries",
)
def file_summary_string(spark, folder):
    """Structural summary and line count of every module."""
    nodes = _outline_nodes(spark, folder)
    return nodes.filter("type = 'CodeFile'").select("file_path", "line_count", "summary")


@query(
    "build_graph_nodes",
    f"""with {PARTS_SQL}, found as ({' union all '.join(_PY_ROWS + _TS_ROWS)}), {SUMMARY_SQL}
    select file_path,
        case when kind in ('function', 'arrow', 'method') then 'CodeFunction'
             when kind in ('class', 'interface', 'type_alias') then 'CodeClass'
             when kind = 'import' then 'CodeImport' when kind = 'export' then 'CodeExport'
             else 'CodeVariable' end as type,
        case when kind <> 'import' then name end as name,
        case when kind in ('function', 'arrow', 'method') then concat_ws('.', parent_name, name) end as qualified_name,
        case kind when 'variable' then 'const' when 'export' then export_kind when 'import' then null else kind end as kind,
        start_line::int as start_line, source_module::varchar as source_module,
        case when kind = 'import' then signature end as import_statement
    from (select * replace (case when kind = 'import' then source_module end as source_module) from found)
    where kind <> 'call'
    union all select file_path, 'CodeFile', null, null, null, null, null, null from summaries""",
)
def build_graph_nodes(spark, folder):
    """Typed nodes of all modules. Exports carry no module of their own."""
    nodes = _outline_nodes(spark, folder)
    module = F.when(F.col("type") == "CodeImport", F.col("source_module"))
    return nodes.withColumn("source_module", module).select(
        "file_path", "type", "name", "qualified_name", "kind", "start_line", "source_module",
        "import_statement",
    )


def _edge(source: str, path: str, start: str, rel: str, end: str) -> str:
    return f"select {path} as file_path, {start} as source, '{rel}' as relationship, {end} as target from {source}"


_PY_TOP = ["'Base'", "'Part' || p_partkey", "'SIZE'", "'LABEL'", "'scale'"]
_TS_TOP = ["'Row' || p_partkey", "'Label' || p_partkey", "'Part' || p_partkey", "'SIZE'", "'scale'"]
_STEP = {"py": "'Part' || p_partkey || '.step_' || i", "ts": "'Part' || p_partkey || '.step' || i"}
_HELPER = {"py": "'helper_' || i", "ts": "'helper' || i"}
_EDGE_ROWS = [
    *[_edge("p", "py", "py", "imports", m) for m in ("'region'", "'nation'", "'.brands.' || brand")],
    *[_edge("p", "ts", "ts", "imports", m) for m in ("'./brands/' || brand", "'./region'")],
    *[_edge("p", "py", "py", "contains_symbols", s) for s in _PY_TOP],
    *[_edge("p", "ts", "ts", "contains_symbols", s) for s in _TS_TOP],
    *[_edge("p", "py", s, "defined_in", "py") for s in _PY_TOP],
    *[_edge("p", "ts", s, "defined_in", "ts") for s in _TS_TOP],
    _edge("p", "py", "'Part' || p_partkey", "inherits_from", "'Base'"),
    *[
        row
        for lang in ("py", "ts")
        for row in (
            _edge("steps", lang, lang, "contains_symbols", _STEP[lang]),
            _edge("steps", lang, lang, "contains_symbols", _HELPER[lang]),
            _edge("steps", lang, _HELPER[lang], "defined_in", lang),
            _edge("steps", lang, _STEP[lang], "defined_in", "'Part' || p_partkey"),
            _edge("steps", lang, "'Part' || p_partkey", "methods", _STEP[lang]),
            _edge("steps", lang, _STEP[lang], "calls", _HELPER[lang]),
            _edge("steps where i = 1", lang, _STEP[lang], "calls", "'scale'"),
        )
    ],
    *[
        row
        for name in ("'Row' || p_partkey", "'Label' || p_partkey", "'Part' || p_partkey", "'scale'")
        for row in (
            _edge("p", "ts", "ts", "exports", f"'export ' || {name}"),
            _edge("p", "ts", f"'export ' || {name}", "exports_symbol", name),
        )
    ],
    _edge("p", "ts", "ts", "exports", "'export ./nation'"),
    _edge("steps", "ts", "ts", "exports", "'export helper' || i"),
    _edge("steps", "ts", "'export helper' || i", "exports_symbol", "'helper' || i"),
]


@query("build_graph_edges", f"with {PARTS_SQL} " + " union all ".join(_EDGE_ROWS))
def build_graph_edges(spark, folder):
    """All relationships of all modules, ends shown by name."""
    files, entities = _graph(spark, folder)
    nodes = code_graph.build_nodes(files, entities)
    name = F.coalesce("qualified_name", "name", "source_module", "file_path")
    labels = nodes.select(
        "id", F.when(F.col("type") == "CodeExport", F.concat(F.lit("export "), "name")).otherwise(name).alias("label")
    )
    edges = code_graph.build_edges(entities)
    # A label per symbol: compressed files look small enough to be sent to the driver, the rows are not.
    labels = labels.hint("merge")
    return (
        edges.join(labels.select(F.col("id").alias("from_id"), F.col("label").alias("source")), "from_id")
        .join(labels.select(F.col("id").alias("to_id"), F.col("label").alias("target")), "to_id")
        .select("file_path", "source", F.col("relationship_name").alias("relationship"), "target")
    )


@query(
    "graph_totals",
    f"""with {PARTS_SQL}, e as ({' union all '.join(_EDGE_ROWS)})
        select relationship, count(*) as edges, count(distinct file_path) as files from e group by all""",
)
def graph_totals(spark, folder):
    """Edges per relationship over all modules. Only edges read the entities, so these are not stored."""
    edges = code_graph.build_edges(code_graph.parse_files(part_modules(spark, folder)))
    return edges.groupBy(F.col("relationship_name").alias("relationship")).agg(
        F.count(F.lit(1)).alias("edges"), F.countDistinct("file_path").alias("files")
    )


@query(
    "class_bases",
    """
    select p_partkey, trim(unnest(string_split(p_name, ' '))) as base, p_brand as class_name from part
    """,
)
def class_bases(spark, folder):
    """Base lists split to rows: the words of a part name as bases of its brand."""
    part = table(spark, folder, "part")
    bases = code_graph.base_names(F.col("p_name"), " ")
    return part.select("p_partkey", F.explode(bases).alias("base"), F.col("p_brand").alias("class_name"))


INTERVALS_SQL = """
    lines as (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by all),
    spans as (
        select l_orderkey as file, l_linenumber as id, l_linenumber as ordinal,
               10 * l_linenumber as s, 10 * l_linenumber + 10 * (max(l_linenumber) over (partition by l_orderkey) - l_linenumber)
               + 9 - l_linenumber as e, 10 * l_linenumber + l_quantity::int % 10 as at
        from lines)"""


def _spans(spark, folder) -> DataFrame:
    """Line numbers of orders as nested ranges (each contains the later ones) and as points."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    # The only exchange: all windows below are within an order, and a task sorts a bounded number of rows.
    items = (
        lines.repartition(partitions_for(lines), "l_orderkey")
        .groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("id"))
        .agg(F.max("l_quantity").alias("l_quantity"))
    )
    last = F.max("id").over(Window.partitionBy("file"))
    start = F.col("id") * 10
    return items.withColumn("last", last).select(
        "file", "id",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("span"), start.alias("s"),
                         (start + (F.col("last") - F.col("id")) * 10 + 9 - F.col("id")).alias("e")),
                F.struct(F.lit(False).alias("span"),
                         (start + F.col("l_quantity").cast("int") % 10).alias("s"),
                         F.lit(None).cast("int").alias("e")),
            )
        ).alias("_r"),
    ).select("file", "id", "_r.*")


@query(
    "enclosing_smallest",
    f"""with {INTERVALS_SQL}
    select p.file, p.id, arg_min(i.id, (i.e - i.s) * 100 + i.id)::int as owner
    from spans p left join spans i on i.file = p.file and p.at between i.s and i.e
    group by p.file, p.id""",
)
def enclosing_smallest(spark, folder):
    """Smallest range around each point; ranges of an order are nested."""
    found = with_enclosing(_spans(spark, folder), ["file"], "s", "e", F.col("span"), ["id"], ["id"], "o")
    return found.filter("not span").select("file", "id", F.col("o.id").alias("owner"))


@query(
    "call_owner_first",
    f"""with {INTERVALS_SQL}
    select p.file, p.id, min(i.ordinal)::int as owner
    from spans p left join spans i on i.file = p.file and p.at between i.s and i.e
    group by p.file, p.id""",
)
def call_owner_first(spark, folder):
    """First range in file order around each point."""
    found = with_enclosing(
        _spans(spark, folder), ["file"], "s", "e", F.col("span"), ["id"], ["id"], "o", outermost=True
    )
    return found.filter("not span").select("file", "id", F.col("o.id").alias("owner"))
