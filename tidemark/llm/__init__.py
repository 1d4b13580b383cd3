"""Training-data operators. Nothing outside this package imports it."""

import importlib

from pyspark import cloudpickle

# Executors may not have this repository on their path, so worker code travels by value.
for _name in ("kernels", "learners", "substrings", "neardup", "quality", "language", "pages", "tokens", "mixing"):
    cloudpickle.register_pickle_by_value(importlib.import_module(f"tidemark.llm.{_name}"))
