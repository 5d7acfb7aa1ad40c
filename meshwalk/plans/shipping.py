"""Python functions travel with their tasks, so executors needn't have the package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module])
