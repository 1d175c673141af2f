"""Fitted models kept for the explanations that follow: written below the shared folder under a hash of request and data."""

from __future__ import annotations

import hashlib
import json
import pickle
from collections import OrderedDict

from pyspark.sql import SparkSession

from ..scratch import written

#: Models that a session keeps; the one used longest ago goes first.
MOST = 8


def signature(**parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class ModelStore:
    """key -> what was fitted, as a written one-row table, so that it needn't stay in the driver's memory."""

    def __init__(self, spark: SparkSession, most: int = MOST):
        self.spark, self.most = spark, most
        self.tables: OrderedDict = OrderedDict()

    def get(self, key: str):
        """What was put under the key, or None. Only this session's own tables are read."""
        if key not in self.tables:
            return None
        self.tables.move_to_end(key)
        return pickle.loads(bytes(self.tables[key].first()["model"]))

    def put(self, key: str, value: object) -> None:
        row = self.spark.createDataFrame([(bytearray(pickle.dumps(value)),)], "model binary")
        self.tables[key] = written(row)
        self.tables.move_to_end(key)
        while len(self.tables) > self.most:
            self.tables.popitem(last=False)
