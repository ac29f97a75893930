"""Ready-made queries over the driver's tables, with oracle SQL."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every plan module; return ({name: (spark, sf_dir) -> DataFrame}, {name: sql})."""
    from . import base

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")

    def bind(fn):
        return lambda spark, sf_dir: fn(base.Tables(spark, sf_dir))

    return {n: bind(f) for n, f in base.QUERIES.items()}, dict(base.ORACLES)
