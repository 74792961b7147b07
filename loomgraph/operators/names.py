"""Symbol-name matching applied after a name search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Advertised kind -> kinds stored on nodes.
KIND_ALIASES = {
    "function": ("function", "arrow"),
    "type": ("type", "type_alias"),
    "variable": ("variable", "const"),
}


def name_matches(name: Column, wanted: Column) -> Column:
    """Case-insensitive substring match in either direction; empty names never match."""
    n, w = F.lower(F.coalesce(name, F.lit(""))), F.lower(wanted)
    return (n != "") & (F.contains(n, w) | F.contains(w, n))


def kind_matches(kind: Column, wanted: Column) -> Column:
    """Kind equality with aliases; a missing kind on either side matches."""
    k, w = F.lower(kind), F.lower(wanted)
    hit = k == w
    for alias, stored in KIND_ALIASES.items():
        hit = hit | ((w == alias) & k.isin(*stored))
    return wanted.isNull() | F.coalesce(k, F.lit("")).eqNullSafe("") | hit


def match_matrix(names: pd.Series, kinds: pd.Series, wanted: pd.Series, wanted_kinds: pd.Series) -> np.ndarray:
    """name_matches and kind_matches for every row against every question, in a scoring pass.

    Decided once per different name and kind of a batch.
    """
    row_names, name_codes = np.unique(names.fillna("").str.lower().to_numpy(str), return_inverse=True)
    row_kinds, kind_codes = np.unique(kinds.fillna("").str.lower().to_numpy(str), return_inverse=True)
    asked = [w.lower() if isinstance(w, str) else None for w in wanted]
    by_name = np.array([[n != "" and w is not None and (w in n or n in w) for w in asked] for n in row_names.tolist()])

    def same_kind(kind: str, want) -> bool:
        return not isinstance(want, str) or kind in ("", want.lower(), *KIND_ALIASES.get(want.lower(), ()))

    by_kind = np.array([[same_kind(k, w) for w in wanted_kinds] for k in row_kinds.tolist()])
    return by_name[name_codes] & by_kind[kind_codes]


def keep_matches_or_all(df: DataFrame, keys: list[str], matched: Column) -> DataFrame:
    """Per question: the matching rows, or every row when none matches.

    One aggregate and one join on the question; question result sets are
    already cut to a fixed size here. Without keys ``df`` is one result set, and
    a job that stops at the first match decides.
    """
    flagged = df.withColumn("_hit", F.coalesce(matched, F.lit(False)))
    if not keys:
        hits = flagged.filter("_hit").drop("_hit")
        return df if hits.isEmpty() else hits
    any_hit = flagged.groupBy(*keys).agg(F.bool_or("_hit").alias("_any"))
    return (
        flagged.join(any_hit, keys).filter(F.col("_hit") | ~F.col("_any")).drop("_hit", "_any")
    )
