"""All named queries of the engine with the SQL that gives the same rows."""

from __future__ import annotations

from lumengrid.plans import content, dimensions, files, folds, gates, grading, graph, learner, live, papers, planning, retrieval, solving, stores, texts  # noqa: F401
from lumengrid.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
