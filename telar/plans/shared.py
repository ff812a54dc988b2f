"""Objects of this package on the executors, where the package need not be installed."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import SparkSession


class Shared:
    """A broadcast of an object whose class travels with it; for objects of bounded size only."""

    def __init__(self, spark: SparkSession, value: object):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value: object = None

    def __getstate__(self) -> dict[str, object]:
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = pickle.loads(self._bytes.value)
        return self._value
