"""Values that every task reads, with a name that worker processes can keep things under."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Shared:
    """A broadcast value of bounded size with a name of its own."""

    def __init__(self, spark: SparkSession, value):
        self.name = uuid.uuid4().hex
        self._held = spark.sparkContext.broadcast(value)

    @property
    def value(self):
        return self._held.value
