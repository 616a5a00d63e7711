"""Sensor-run analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from .settings import Settings

# Functions sent to Python workers travel with their code: workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]
