"""Named queries over the driver tables."""

from __future__ import annotations

import importlib

MODULES = (
    "text_queries",
    "style_queries",
    "scoring_queries",
    "lifecycle_queries",
    "segment_queries",
    "vector_queries",
    "report_queries",
    "source_queries",
    "streaming_queries",
    "function_queries",
)


def load_catalog():
    for module in MODULES:
        importlib.import_module(f"markwell.plans.{module}")
    from markwell.plans.catalog import CATALOG

    return CATALOG
