"""Functions that run in Python workers travel by value."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that workers need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)
