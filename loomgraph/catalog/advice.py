"""Skill registry and matching over skills written from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.catalog.registry import query
from loomgraph.catalog.vectors import words_sql
from loomgraph.operators import skills
from loomgraph.sources.skills import invalid_reason
from loomgraph.sources.tables import table

SKILLS_SQL = """
    raw as (
        select replace(p_name, ' ', '-') as name, lower(p_type) || ' ' || p_name as description,
            case when p_size > 45 then 'unknown' when p_size % 2 = 0 then 'tool' else 'pattern' end as category,
            list_sort(list_distinct([lower(p_type), string_split(p_name, ' ')[1], string_split(p_name, ' ')[2], lower(p_brand)])) as domains,
            [string_split(p_name, ' ')[2]] as triggers, p_size as priority,
            [string_split(p_name, ' ')[1] || '-bolt'] as depends_on, p_partkey as ord, p_brand as source from part),
    valid as (select * from raw where category <> 'unknown'),
    reg as (select * from valid qualify row_number() over (partition by name order by priority desc, ord) = 1)"""


def part_skills(spark, folder):
    """One skill candidate per part; parts of one name compete for it by size."""
    first, second = F.get(F.split("p_name", " "), F.lit(0)), F.get(F.split("p_name", " "), F.lit(1))
    kind = F.lower("p_type")
    category = (
        F.when(F.col("p_size") > 45, "unknown").when(F.col("p_size") % 2 == 0, "tool").otherwise("pattern")
    )
    return table(spark, folder, "part").select(
        F.replace("p_name", F.lit(" "), F.lit("-")).alias("name"),
        F.concat_ws(" ", kind, "p_name").alias("description"),
        category.alias("category"),
        F.array_sort(F.array_distinct(F.array(kind, first, second, F.lower("p_brand")))).alias("domains"),
        F.array(second).alias("triggers"),
        F.col("p_size").alias("priority"),
        F.array(F.concat(first, F.lit("-bolt"))).alias("depends_on"),
        F.concat(F.lit("About "), "p_name").alias("body"),
        F.col("p_partkey").alias("ord"),
        F.col("p_brand").alias("source"),
    )


def _registered(spark, folder):
    return skills.register(part_skills(spark, folder).filter(invalid_reason().isNull()))


@query("skill_priority", f"with {SKILLS_SQL} select name, priority, ord, category from reg")
def skill_priority(spark, folder):
    return _registered(spark, folder).select("name", "priority", "ord", "category")


@query(
    "skill_conflicts",
    f"""with {SKILLS_SQL},
    met as (select *, max(priority) over w as best,
                arg_max(source, {{p: priority, o: -ord}}) over w as other
            from valid window w as (partition by name order by ord rows between unbounded preceding and 1 preceding))
    select name, case when priority > best then 'overrides' else 'dropped in favour of' end as outcome,
        source, priority, other as other_source, best as other_priority from met where best is not null""",
)
def skill_conflicts(spark, folder):
    valid = part_skills(spark, folder).filter(invalid_reason().isNull())
    return skills.conflicts(valid)


@query(
    "domain_overlap",
    f"""with {SKILLS_SQL}
    select a.category, a.name as first, b.name as second, list_sort(list_intersect(a.domains, b.domains)) as shared
    from reg a join reg b on a.category = b.category and (a.ord < b.ord)
    where length(list_intersect(a.domains, b.domains)) / least(length(a.domains), length(b.domains)) > 0.5""",
)
def domain_overlap(spark, folder):
    return skills.domain_overlaps(_registered(spark, folder))


MATCH_SQL = f"""
    with {SKILLS_SQL},
    asked as (select distinct p_name as query_id, 'how to fit a ' || p_name as query_text from part),
    qw as ({words_sql("(select query_id as id, query_text as text from asked)", "text")}),
    sw as ({words_sql("(select name as id, description || ' ' || array_to_string(domains, ' ') || ' ' || array_to_string(triggers, ' ') as text from reg)", "text")}),
    qn as (select id, sqrt(sum(n * n)) as len from (select id, bucket, sum(n) as n from qw group by all) group by id),
    sn as (select id, sqrt(sum(n * n)) as len from (select id, bucket, sum(n) as n from sw group by all) group by id),
    dots as (select qw.id as query_id, sw.id, sum(qw.n * sw.n) as dot from qw join sw using (bucket) group by all),
    scored as (
        select a.query_id, a.query_text, s.name, s.depends_on, coalesce(dot / (qn.len * sn.len), 0) as cos,
            len(list_filter(s.triggers, lambda t: contains(lower(a.query_text), lower(t)))) > 0 as hit,
            list_has_any(s.domains, ['economy', 'blue']) as fw
        from asked a cross join reg s
        left join dots on dots.query_id = a.query_id and dots.id = s.name
        left join qn on qn.id = a.query_id left join sn on sn.id = s.name),
    ranked as (
        select *, round(1 - (round(1 - (cos + case when hit then 0.3::double else 0 end + case when fw then 0.2::double else 0 end), 6) + 0.0), 6) as score
        from scored),
    best as (select * from ranked qualify row_number() over (partition by query_id order by -score, name) <= 3)"""


def _matches(spark, folder):
    registered = skills.embedded(_registered(spark, folder))
    names = table(spark, folder, "part").select(F.col("p_name").alias("query_id")).distinct()
    asked = names.withColumn("query_text", F.concat(F.lit("how to fit a "), "query_id"))
    return skills.match(registered, asked, 3, ["economy", "blue"]), registered


@query("skill_scores", f"{MATCH_SQL} select query_id, name, score from best")
def skill_scores(spark, folder):
    """Top three skills for every part name, with trigger and framework boosts."""
    return _matches(spark, folder)[0].select("query_id", "name", "score")


EXPANDED_SQL = f"""{MATCH_SQL},
    prim as (select * from best qualify row_number() over (partition by query_id order by -score, name) = 1),
    deps as (select query_id, name as prim, round(score * 0.8::double, 6) as share, unnest(depends_on) as name from prim),
    known as (select * from deps where name in (select name from reg)),
    expanded as (
        select coalesce(b.query_id, k.query_id) as query_id, coalesce(b.name, k.name) as name,
            greatest(b.score, k.share) as score, k.prim is not null as dependency
        from best b full outer join known k on k.query_id = b.query_id and k.name = b.name)"""


@query("dep_expansion", f"{EXPANDED_SQL} select * from expanded")
def dep_expansion(spark, folder):
    matches, registered = _matches(spark, folder)
    found = skills.expand_dependencies(matches, registered)
    dependency = F.exists("reasons", lambda r: r.startswith("dependency of"))
    return found.select("query_id", "name", "score", dependency.alias("dependency"))


@query(
    "advise",
    f"""{EXPANDED_SQL},
    kept as (select *, row_number() over (partition by query_id order by -score, name) as rank from expanded where score >= 0.9)
    select k.query_id, k.rank::int as rank, k.name, r.category, round(k.score, 3) as score,
        case when k.rank = 1 then 'About ' || replace(k.name, '-', ' ') end as content
    from kept k join reg r on r.name = k.name""",
)
def advise(spark, folder):
    """Whole advice chain with a minimum score of 0.9; the first result has the text."""
    matches, registered = _matches(spark, folder)
    found = skills.advice(skills.expand_dependencies(matches, registered), registered, 0.9)
    return found.select("query_id", "rank", "name", "category", "score", "content")


@query(
    "skill_list",
    f"with {SKILLS_SQL} select name, category, description, domains, source, priority from reg",
)
def skill_list(spark, folder):
    return skills.skill_list(_registered(spark, folder))


@query(
    "domain_index",
    f"with {SKILLS_SQL} select unnest(domains) as domain, name from reg",
)
def domain_index(spark, folder):
    return skills.domain_index(_registered(spark, folder)).select("domain", "name")
