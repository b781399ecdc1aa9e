"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from textdist.registry.base import QUERIES, SQL
from textdist.registry import (  # noqa: F401  (importing registers)
    corpus, diversity, divergence, manifold, prompts, relational, runs, sampling, storage, vectors,
)

__all__ = ["QUERIES", "SQL"]
