"""Named snapshots of tables: at most so many, least recently used first out, idle ones too."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotFoundError


def table_hash(df: DataFrame) -> str:
    """16 hexadecimal digits of schema and rows, whatever their order."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns]).cast("decimal(38,0)")).alias("s")).first()
    import hashlib

    return hashlib.sha256(f"{df.schema.simpleString()}|{r.n}|{r.s}".encode()).hexdigest()[:16]


@dataclass
class Snapshot:
    df: DataFrame
    name: str
    hash: str
    derived: dict[str, dict] = field(default_factory=dict)
    used: float = 0.0


class DatasetStore:
    """DataFrames are immutable, so a snapshot is a reference; deriving a column makes a new id."""

    def __init__(self, limit: int = 10, idle_seconds: float = 3600.0, clock=time.monotonic):
        self.limit, self.idle, self.clock = limit, idle_seconds, clock
        self.items: OrderedDict[str, Snapshot] = OrderedDict()
        self.lock = threading.RLock()

    def put(self, df: DataFrame, name: str, derived: dict | None = None, cache: bool = False) -> str:
        with self.lock:
            key = uuid.uuid4().hex[:12]
            self.items[key] = Snapshot(df.cache() if cache else df, name, table_hash(df), dict(derived or {}), self.clock())
            self.evict()
            return key

    def get(self, key: str) -> Snapshot:
        with self.lock:
            self.evict()
            if key not in self.items:
                raise NotFoundError(f"No dataset {key}; it may have been dropped after a while without use")
            self.items.move_to_end(key)
            self.items[key].used = self.clock()
            return self.items[key]

    def derive(self, key: str, df: DataFrame, column: str, recipe: dict) -> str:
        old = self.get(key)
        return self.put(df, old.name, old.derived | {column: recipe})

    def evict(self) -> None:
        now = self.clock()
        for k in [k for k, s in self.items.items() if now - s.used > self.idle]:
            self.items.pop(k).df.unpersist()
        while len(self.items) > self.limit:
            self.items.popitem(last=False)[1].df.unpersist()
