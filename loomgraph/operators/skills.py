"""Skill registry: conflicts, domain overlaps, matching, dependency expansion, advice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomgraph.functions.embedding import Embedder, cosine_similarity, hash_embedder
from loomgraph.operators.nearest import nearest
from loomgraph.operators.topk import top_k
from loomgraph.settings import MIN_SIMILARITY

# Score added by a trigger phrase and by a framework, and the share
# of the best score its dependencies get.
TRIGGER_BOOST = 0.3
FRAMEWORK_BOOST = 0.2
DEPENDENCY_SHARE = 0.8
OVERLAP_SHARE = 0.5
SCORE_DIGITS = 6


def register(skills: DataFrame) -> DataFrame:
    """One skill per name: the highest priority, and of equals the one loaded first.

    A map-side combined aggregate, so any number of rivals for a name is fine.
    """
    rest = [c for c in skills.columns if c != "name"]
    winner = F.min_by(F.struct(*rest), F.struct((-F.col("priority")).alias("p"), F.col("ord")))
    return skills.groupBy("name").agg(winner.alias("_w")).select("name", "_w.*").select(*skills.columns)


def conflicts(skills: DataFrame) -> DataFrame:
    """One row per skill that met an earlier one of its name: who is kept at that point.

    The holder is the first skill loaded with the highest priority so far. As
    priorities run from 0 to 100, a name has at most 101 candidates for it; they
    travel as one array per name, however many skills share the name.
    """
    firsts = skills.groupBy("name", "priority").agg(
        F.min("ord").alias("ord"), F.min_by("source", "ord").alias("source")
    )
    ladders = firsts.groupBy("name").agg(
        F.collect_list(F.struct("priority", (-F.col("ord")).alias("back"), "source")).alias("_ladder")
    )
    holder = F.array_max(F.filter("_ladder", lambda h: -h["back"] < F.col("ord")))
    met = skills.join(ladders, "name").withColumn("_holder", holder).filter("_holder is not null")
    overrides = F.col("priority") > F.col("_holder.priority")
    return met.select(
        "name",
        F.when(overrides, "overrides").otherwise("dropped in favour of").alias("outcome"),
        "source",
        "priority",
        F.col("_holder.source").alias("other_source"),
        F.col("_holder.priority").alias("other_priority"),
    )


def domain_overlaps(skills: DataFrame) -> DataFrame:
    """Pairs of one category that share over half of the smaller one's domains.

    For such a pair the rarer half of the smaller set holds at least one shared
    domain, so only rows meeting on one of those are joined: a domain nearly
    every skill has joins nothing unless it is all a skill has.
    """
    sets = skills.select("name", "category", "ord", F.array_distinct("domains").alias("domains"))
    sets = sets.filter(F.size("domains") > 0)
    rows = sets.select("name", "category", "ord", F.size("domains").alias("n"), F.explode("domains").alias("domain"))
    frequency = rows.groupBy("category", "domain").agg(F.count(F.lit(1)).alias("_f"))
    ranked = rows.join(frequency, ["category", "domain"]).withColumn(
        "_r",
        F.row_number().over(Window.partitionBy("category", "name").orderBy("_f", "domain")),
    )
    rare = ranked.filter(F.col("_r") <= F.ceil(F.col("n") / 2)).select(
        "category", "domain", F.col("name").alias("small"), F.col("ord").alias("small_ord"), F.col("n").alias("small_n")
    )
    pairs = (
        rare.join(rows, ["category", "domain"])
        .filter(
            (F.col("small") != F.col("name"))
            & (
                (F.col("small_n") < F.col("n"))
                | ((F.col("small_n") == F.col("n")) & (F.col("small_ord") < F.col("ord")))
                | (
                    (F.col("small_n") == F.col("n"))
                    & (F.col("small_ord") == F.col("ord"))
                    & (F.col("small") < F.col("name"))
                )
            )
        )
        .select("category", "small", "small_ord", F.col("name").alias("large"), F.col("ord").alias("large_ord"))
        .distinct()
    )
    small = sets.select(F.col("name").alias("small"), "category", F.col("domains").alias("_a"))
    large = sets.select(F.col("name").alias("large"), "category", F.col("domains").alias("_b"))
    shared = F.array_sort(F.array_intersect("_a", "_b"))
    first_is_small = F.struct("small_ord", "small") < F.struct("large_ord", "large")
    return (
        pairs.join(small, ["category", "small"])
        .join(large, ["category", "large"])
        .withColumn("shared", shared)
        .filter(F.size("shared") / F.least(F.size("_a"), F.size("_b")) > OVERLAP_SHARE)
        .select(
            "category",
            F.when(first_is_small, F.col("small")).otherwise(F.col("large")).alias("first"),
            F.when(first_is_small, F.col("large")).otherwise(F.col("small")).alias("second"),
            "shared",
        )
    )


def domain_index(skills: DataFrame) -> DataFrame:
    """(domain, name) rows: the registry by domain, one row per entry."""
    return skills.select(F.explode("domains").alias("domain"), "name", "ord")


def embedded(skills: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Skills with the vector of their description, domains and triggers."""
    text = F.concat_ws(
        " ", "description", F.array_join("domains", " "), F.array_join("triggers", " ")
    )
    return skills.withColumn("embedding", (embed or hash_embedder())(text))


def match(
    skills: DataFrame,
    questions: DataFrame,
    k: int = 3,
    frameworks: list[str] | None = None,
    embed: Embedder | None = None,
) -> DataFrame:
    """Top-k skills per question by cosine plus boosts, with the reasons.

    ``skills`` comes from :func:`embedded`; ``questions`` has ``query_id`` and
    ``query_text``. Boosts are added inside the scoring pass, so the cut is
    exact and no question-skill pair outside the top k leaves a task.
    """
    embed = embed or hash_embedder()
    known = F.array(*[F.lit(f) for f in frameworks or ()]).cast("array<string>")
    stored = skills.select(
        F.col("name").alias("id"),
        "embedding",
        F.transform("triggers", lambda t: F.lower(t)).alias("_triggers"),
        F.arrays_overlap("domains", known).cast("double").alias("_framework"),
    )
    asked = questions.select("query_id", F.lower("query_text").alias("_question"), embed(F.col("query_text")).alias("embedding"))
    hits = nearest(
        stored, asked, k, extra=["_triggers", "_framework", "_question"], bonus=_boosts
    )
    detail = (
        hits.join(skills, hits.id == skills.name)
        .join(questions.select("query_id", "query_text", embed(F.col("query_text")).alias("_q")), "query_id")
        .withColumn("similarity", F.round(cosine_similarity(F.col("_q"), F.col("embedding")), SCORE_DIGITS))
    )
    question = F.lower("query_text")
    trigger = F.get(F.filter("triggers", lambda t: F.contains(question, F.lower(t))), F.lit(0))
    shared = F.array_sort(F.array_intersect("domains", known))
    reasons = F.array_compact(
        F.array(
            F.format_string("similarity=%.3f", "similarity"),
            F.when(trigger.isNotNull(), F.concat(F.lit("trigger match: '"), trigger, F.lit("'"))),
            F.when(
                F.size(shared) > 0,
                F.concat(F.lit("framework match: {"), F.array_join(F.transform(shared, lambda d: F.concat(F.lit("'"), d, F.lit("'"))), ", "), F.lit("}")),
            ),
        )
    )
    return detail.select(
        "query_id", "name", F.round(1 - F.col("distance"), SCORE_DIGITS).alias("score"),
        "similarity", reasons.alias("reasons"),
    )


def _boosts(rows: pd.DataFrame, asked: pd.DataFrame) -> np.ndarray:
    questions = list(asked["_question"])
    boost = np.zeros((len(rows), len(questions)))
    for i, triggers in enumerate(rows["_triggers"]):
        if triggers is not None and len(triggers):
            boost[i] = [TRIGGER_BOOST * any(t in q for t in triggers) for q in questions]
    return boost + FRAMEWORK_BOOST * rows["_framework"].fillna(0).to_numpy()[:, None]


def _best_first() -> list[Column]:
    return [F.col("score").desc(), F.col("name")]


def expand_dependencies(matches: DataFrame, skills: DataFrame) -> DataFrame:
    """Raise or add the skills the best match depends on, at a share of its score."""
    best = top_k(matches, ["query_id"], _best_first(), 1)
    wanted = (
        best.join(skills.select("name", "depends_on"), "name")
        .select(
            "query_id",
            F.round(F.col("score") * DEPENDENCY_SHARE, SCORE_DIGITS).alias("_share"),
            F.col("name").alias("_primary"),
            F.explode(F.array_distinct("depends_on")).alias("name"),
        )
        .join(skills.select("name"), "name", "left_semi")
    )
    reason = F.concat(F.lit("dependency of "), "_primary")
    none = F.array().cast("array<string>")
    return (
        matches.join(wanted, ["query_id", "name"], "full_outer")
        .withColumn("reasons", F.concat(F.coalesce("reasons", none), F.when(F.col("_primary").isNotNull(), F.array(reason)).otherwise(none)))
        .withColumn("score", F.greatest("score", "_share"))
        .drop("_share", "_primary")
    )


def advice(
    matches: DataFrame, skills: DataFrame, min_score: float = MIN_SIMILARITY
) -> DataFrame:
    """Ranked advice: relevant matches only, the full text for the first of a question."""
    order = Window.partitionBy("query_id").orderBy(*_best_first())
    relevant = matches.filter(F.col("score") >= min_score).withColumn("rank", F.row_number().over(order))
    return relevant.join(skills, "name").select(
        "query_id", "rank", "name", "category", "description",
        F.round("score", 3).alias("score"), "reasons", "domains",
        F.when(F.col("rank") == 1, F.col("body")).alias("content"),
    )


def skill_list(skills: DataFrame) -> DataFrame:
    return skills.select(
        "name", "category", "description", "domains", "source", "priority"
    ).orderBy("name")
