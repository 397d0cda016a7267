"""All programme tables as they were at one moment, renewed when they are older than a time to live."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strata.sources.tables import Tables, load_tables

HOUR = 3600.0


class Snapshot:
    """Tables of one location, listed together and kept.

    Loading lists each table's files; every plan made from the snapshot reads exactly these, so files that
    arrive later stay unseen, and all tables change at the same time: a reload lists all of them first and then
    swaps them in as one.  ``ttl`` (seconds, None: never) is checked whenever the tables are asked for.
    """

    def __init__(self, spark: SparkSession, location: str, fmt: str = "parquet", ttl: float | None = HOUR, cache: bool = False,
                 clock: Callable[[], float] = time.monotonic, **options):
        self.spark, self.location, self.ttl = spark, location, ttl
        self._fmt, self._cache, self._clock, self._options = fmt, cache, clock, options
        self.version = 0
        self._tables, self._loaded = None, None
        self.reload()

    @property
    def age(self) -> float:
        return self._clock() - self._loaded

    @property
    def expired(self) -> bool:
        return self.ttl is not None and self.age > self.ttl

    @property
    def tables(self) -> Tables:
        """The snapshot's tables; a new snapshot if this one has expired."""
        if self.expired:
            self.reload()
        return self._tables

    def reload(self) -> Tables:
        """Take a new snapshot now."""
        old = self._tables
        if old is not None:
            self._forget_listings(old)
        fresh = load_tables(self.spark, self.location, fmt=self._fmt, cache=self._cache, **self._options)
        self._tables, self._loaded, self.version = fresh, self._clock(), self.version + 1
        if old is not None:
            old.unpersist()
        return fresh

    def _forget_listings(self, tables: Tables) -> None:
        """Drop what the session remembers of the tables' files."""
        if "/" in self.location or self.location.startswith("."):
            self.spark.catalog.refreshByPath(self.location)
            return
        for name in tables.frames:
            if name not in tables.missing:
                self.spark.catalog.refreshTable(f"{self.location}.{name}")

    def manifest(self) -> DataFrame:
        """(table_name, file): what the snapshot reads, as the plans hold it."""
        rows = [(name, f) for name, df in self._tables.frames.items() for f in df.inputFiles()]
        return self.spark.createDataFrame(rows, "table_name string, file string").withColumn("version", F.lit(self.version))
