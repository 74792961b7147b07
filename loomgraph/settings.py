"""Tunables, read from the environment under the ``LOOMGRAPH_`` prefix."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Operating parameters that results depend on.
EMBEDDING_DIM = 384
MAX_FILE_SIZE_KB = 500
MIN_SIMILARITY = 0.3
DEBOUNCE_SECONDS = 2


@dataclass(frozen=True)
class Settings:
    data_dir: str = "loomgraph-data"
    embedding_dim: int = EMBEDDING_DIM
    max_file_size_kb: int = MAX_FILE_SIZE_KB
    advisor_enabled: bool = True
    advisor_min_similarity: float = MIN_SIMILARITY
    debounce_seconds: int = DEBOUNCE_SECONDS
    # Watch a repository once it is indexed.
    auto_watch: bool = False
    # Compare the active repositories with their index at every response.
    stale_check: bool = True
    user_skills_dir: str | None = None
    builtin_skills_dir: str | None = None
    # Largest set of question vectors shipped to executors in one piece.
    query_broadcast_bytes: int = 64 * 1024 * 1024
    # Folders that a snapshot's rows are dealt to by file path; a refresh writes those it touches.
    store_buckets: int = 8
    # Snapshots a bucket may have before it is rewritten as one.
    store_deltas: int = 8

    @classmethod
    def from_env(cls, environ: dict[str, str] | None = None) -> "Settings":
        env = os.environ if environ is None else environ
        values = {}
        for field in fields(cls):
            raw = env.get("LOOMGRAPH_" + field.name.upper())
            if raw is None:
                continue
            default = field.default
            if isinstance(default, bool):
                values[field.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(default, (int, float)):
                values[field.name] = type(default)(raw)
            else:
                values[field.name] = raw
        return cls(**values)
