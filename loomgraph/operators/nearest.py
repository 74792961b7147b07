"""Exact nearest-neighbour search for a set of questions in one pass.

The question vectors are shipped to the executors only up to a byte limit, and
every slice of stored vectors is scored with one matrix product. A task keeps
at most k rows per question and group, or k distinct copies where rows have
a copy key. Questions beyond the limit go through a grid of bounded cells instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loomgraph.operators.topk import keep_best, top_k
from loomgraph.session import work_partitions
from loomgraph.settings import Settings

DISTANCE_DIGITS = 6
_QUESTION_CHUNK = 256
_CELL_ROWS = 50_000
# Distances held at once, and candidates a task gathers before it cuts them.
_MATRIX_CELLS = 2_000_000
_HELD_ROWS = 50_000
_SLICE_ROWS = 1_000

# (stored rows, question rows) -> matrix added to the similarity
Bonus = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def _matrix(vectors: Sequence) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best_rows(
    rows: pd.DataFrame,
    stored: np.ndarray,
    questions: pd.DataFrame,
    groups: Sequence[str],
    k: int,
    bonus: Bonus | None,
    copies: str | None = None,
    carry: Sequence[str] = (),
) -> Iterator[pd.DataFrame]:
    """The k closest stored rows (of different copy keys) per question and group among ``rows``."""
    rows = rows.reset_index(drop=True)
    order = rows["id"].argsort(kind="stable").to_numpy()  # ties go to the smaller id
    rows, stored = rows.iloc[order].reset_index(drop=True), _unit(stored[order])
    members = (
        [np.sort(m) for m in rows.groupby(list(groups), sort=False, dropna=False).indices.values()]
        if groups
        else [np.arange(len(rows))]
    )
    codes = None if copies is None else pd.factorize(rows[copies], use_na_sentinel=False)[0]
    columns = list(dict.fromkeys([*groups, "id", *([*carry, copies] if copies else [])]))
    step = max(1, min(_QUESTION_CHUNK, _MATRIX_CELLS // len(rows)))
    for begin in range(0, len(questions), step):
        chunk = questions.iloc[begin : begin + step]
        distance = _unit(_matrix(chunk["embedding"])) @ stored.T
        if bonus is not None:
            distance += bonus(rows, chunk).T
        np.subtract(1.0, distance, out=distance)
        for member in members:
            block = distance if len(members) == 1 else distance[:, member]
            asked, at, rounded = _closest(block, k, None if codes is None else codes[member])
            out = rows.loc[member[at], columns].reset_index(drop=True)
            out.insert(0, "query_id", chunk["query_id"].to_numpy()[asked])
            out["distance"] = rounded
            yield out


def _closest(distance: np.ndarray, k: int, codes: np.ndarray | None = None, upto: int | None = None):
    """Question, position and rounded distance of the first k (of different codes) of each row.

    Only what lies within rounding of the k-th distance is rounded and sorted. With
    codes a prefix that holds k different ones is enough; most have no copies.
    """
    upto = upto or (k if codes is None else 2 * k)
    if upto < distance.shape[1]:
        last = np.partition(distance, upto - 1, axis=1)[:, upto - 1 : upto]
        asked, at = np.nonzero(~(distance > last + 2 * 10.0**-DISTANCE_DIGITS))
    else:
        asked, at = np.nonzero(np.ones(distance.shape, dtype=bool))
    rounded = np.round(distance[asked, at], DISTANCE_DIGITS) + 0.0
    order = np.lexsort((at, rounded, asked))
    order = order[np.arange(len(order)) - np.searchsorted(asked, asked) < upto]
    if codes is not None:
        order = order[np.sort(np.unique(asked[order] * (codes.max() + 1) + codes[at[order]], return_index=True)[1])]
        sorted_asked = asked[order]
        order = order[np.arange(len(order)) - np.searchsorted(sorted_asked, sorted_asked) < k]
    asked, at, rounded = asked[order], at[order], rounded[order]
    short = np.flatnonzero(np.bincount(asked, minlength=len(distance)) < k)
    if codes is None or upto >= distance.shape[1] or not len(short):
        return asked, at, rounded
    more = _closest(distance[short], k, codes, 4 * upto)
    enough = ~np.isin(asked, short)
    return tuple(np.concatenate(p) for p in zip((asked[enough], at[enough], rounded[enough]), (short[more[0]], *more[1:])))


def _running_best(
    found: Iterator[pd.DataFrame], groups: Sequence[str], k: int, copies: str | None
) -> Iterator[pd.DataFrame]:
    """Cuts a task's candidates to k per question and group whenever many have gathered."""
    key = ["query_id", *groups]

    def cut() -> pd.DataFrame:
        best = pd.concat(held, ignore_index=True).sort_values([*key, "distance", "id"], kind="stable")
        if copies:
            best = best.drop_duplicates(list(dict.fromkeys([*key, copies])))
        return best.groupby(key, sort=False, dropna=False).head(k)

    held, size = [], 0
    for out in found:
        held.append(out)
        size += len(out)
        if size > _HELD_ROWS:
            held = [cut()]
            size = len(held[0])
            if size > _HELD_ROWS // 2:  # so many questions and groups that cutting here does not pay
                yield held[0]
                held, size = [], 0
    if held:
        yield cut()


def nearest(
    vectors: DataFrame,
    questions: DataFrame,
    k: int,
    groups: Sequence[str] = (),
    extra: Sequence[str] = (),
    bonus: Bonus | None = None,
    settings: Settings | None = None,
    copies: str | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """``k`` smallest cosine distances per question and per distinct ``groups`` value.

    ``vectors`` has ``id``, ``embedding`` and the group columns; ``questions`` has
    ``query_id`` and ``embedding``. Distances are rounded before ranking and ties
    go to the smaller id, so the result does not depend on partitioning.
    ``extra`` columns of either side are handed to ``bonus``, whose values are
    added to the similarity. Of rows with an equal ``copies`` value only the closest
    counts, before anything is cut. ``carry`` columns of the vectors stay on the hits.
    Vectors without an embedding are left out.
    """
    settings = settings or Settings.from_env()
    stored_extra = [c for c in extra if c in vectors.columns]
    question_extra = [c for c in extra if c in questions.columns]
    carried = [*carry, *([copies] if copies else [])]
    plain = [c for c in dict.fromkeys([*carried, *stored_extra]) if c not in groups]
    vectors = vectors.select("id", *groups, *plain, "embedding").where("embedding is not null")
    questions = questions.select("query_id", *question_extra, "embedding")
    kind = {f.name: f.dataType for f in vectors.schema.fields}
    schema = T.StructType(
        [
            T.StructField("query_id", questions.schema["query_id"].dataType),
            *[T.StructField(g, kind[g]) for g in groups],
            T.StructField("id", kind["id"]),
            *[T.StructField(c, kind[c]) for c in carried],
            T.StructField("distance", T.DoubleType()),
        ]
    )

    room = max(1, settings.query_broadcast_bytes // (8 * settings.embedding_dim))
    shipped = questions.limit(room + 1).toPandas()
    if len(shipped) <= room:
        candidates = _score_shipped(vectors, shipped, k, groups, bonus, schema, copies, carry)
    else:
        candidates = _score_grid(vectors, questions, k, groups, bonus, schema, room, copies, carry)
    if copies:
        candidates = keep_best(candidates, ["query_id", *groups, copies], [F.col("distance"), F.col("id")])
    return top_k(
        candidates,
        ["query_id", *groups],
        [F.col("distance"), F.col("id")],
        k,
        spread_on="id",
    )


def _score_shipped(vectors, shipped, k, groups, bonus, schema, copies, carry) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(shipped)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        questions = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows if len(questions) else 0, _SLICE_ROWS):
                batch = whole.slice(begin, _SLICE_ROWS)
                lists = batch.column("embedding")
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                stored = flat.reshape(batch.num_rows, -1).astype(np.float64)
                rows = batch.drop_columns(["embedding"]).to_pandas()
                yield from _best_rows(rows, stored, questions, groups, k, bonus, copies, carry)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in _running_best(scored(batches), groups, k, copies):
            yield pa.RecordBatch.from_pandas(out, schema=arrow_schema, preserve_index=False)

    arrow_schema = _arrow(schema)
    return vectors.mapInArrow(score, schema)


def _score_grid(vectors, questions, k, groups, bonus, schema, room, copies, carry) -> DataFrame:
    """Questions too many to ship: meet in cells of bounded size on both sides."""
    question_blocks = ceil(questions.count() / room)
    stored_blocks = max(1, ceil(vectors.count() / _CELL_ROWS))
    left = vectors.withColumn(
        "_sb", F.pmod(F.xxhash64("id", *groups), F.lit(stored_blocks))
    ).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(question_blocks - 1))))
    right = questions.withColumn(
        "_qb", F.pmod(F.xxhash64("query_id"), F.lit(question_blocks)).cast("int")
    ).withColumn(
        "_sb", F.explode(F.sequence(F.lit(0), F.lit(stored_blocks - 1)).cast("array<bigint>"))
    )
    names = schema.names

    def cell(stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if stored.empty or asked.empty:
            return pd.DataFrame(columns=names)
        parts = _best_rows(stored, _matrix(stored["embedding"]), asked, groups, k, bonus, copies, carry)
        return pd.concat(list(parts), ignore_index=True)[names]

    # The work of a cell is far above its bytes: as many tasks as cells, so that a task
    # does not grow with the tables.
    tasks = max(work_partitions(vectors.sparkSession), question_blocks * stored_blocks)
    left, right = (side.repartition(tasks, "_qb", "_sb") for side in (left, right))
    return left.groupBy("_qb", "_sb").cogroup(right.groupBy("_qb", "_sb")).applyInPandas(cell, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
