"""End-to-end compositions and the registry of checked queries."""

import importlib

_MODULES = ["evaluation_queries", "run_queries", "text_queries", "model_queries", "source_queries", "extra_queries"]


def load_all() -> None:
    for m in _MODULES:
        importlib.import_module(f"respan.plans.{m}")
