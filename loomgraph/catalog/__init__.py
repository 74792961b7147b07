"""The registered queries with the SQL they are checked against."""

from __future__ import annotations

from loomgraph.catalog.registry import REGISTERED
from loomgraph.catalog import advice, files, graphs, sources, usage, vectors  # noqa: F401,E402

__all__ = ["REGISTERED"]
