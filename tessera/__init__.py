"""Tessera: build and search a chunked knowledge base with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tessera.config import (
    ChunkRules,
    FusionWeights,
    IngestConfig,
    PlannerConfig,
    SearchConfig,
)
from tessera.plans.build import build_chunks
from tessera.plans.context import build_context
from tessera.plans.ingest import incremental_ingest
from tessera.plans.planner import plan_queries
from tessera.plans.relax import search_with_relaxation
from tessera.plans.search import hybrid_search

__all__ = [
    "ChunkRules",
    "FusionWeights",
    "IngestConfig",
    "PlannerConfig",
    "SearchConfig",
    "build_chunks",
    "build_context",
    "hybrid_search",
    "incremental_ingest",
    "plan_queries",
    "search_with_relaxation",
]

# Task code travels with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
