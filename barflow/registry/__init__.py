from __future__ import annotations

import functools
import importlib

from barflow.registry import core
from barflow.session import ship

MODULES = ["indicators", "bars", "structure", "rules", "context", "text", "learning", "stores"]


def _with_package(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        ship(spark)
        return fn(spark, sf_dir)

    return run


def all_queries():
    for m in MODULES:
        importlib.import_module(f"barflow.registry.{m}")
    return {k: _with_package(f) for k, f in core.QUERIES.items()}, dict(core.ORACLES)
