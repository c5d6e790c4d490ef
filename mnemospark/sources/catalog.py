"""Databases and collections in the Spark catalog: names, versions, and atomic replacement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.stats import collection_stats

_NAME = re.compile(r"[a-z][a-z0-9_-]{0,62}")


class VersionConflict(RuntimeError):
    """The collection changed since the caller read it."""


def valid_name(name: str) -> bool:
    return _NAME.fullmatch(name) is not None


class Database:
    """Collections of vectors of one dimension; every replacement of a collection writes a new version of it."""

    def __init__(self, spark: SparkSession, name: str, d: int) -> None:
        if not valid_name(name):
            raise ValueError(f"{name!r} is no database name")
        self.spark, self.name, self.d = spark, name, d
        self._schema = name.replace("-", "_")
        spark.sql(f"create database if not exists `{self._schema}` with dbproperties (dimension = '{d}')")

    @classmethod
    def names(cls, spark: SparkSession) -> list[str]:
        return sorted(d.name for d in spark.catalog.listDatabases())

    def drop(self) -> None:
        self.spark.sql(f"drop database if exists `{self._schema}` cascade")

    def _table(self, collection: str, version: int) -> str:
        return f"`{self._schema}`.`c_{collection.encode().hex()}_{version}`"

    def _versions(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for t in self.spark.catalog.listTables(self._schema):
            if m := re.fullmatch(r"c_([0-9a-f]+)_(\d+)", t.name):
                collection = bytes.fromhex(m[1]).decode()
                found[collection] = max(found.get(collection, 0), int(m[2]))
        return found

    def collections(self) -> list[str]:
        return sorted(self._versions())

    def version(self, collection: str) -> int:
        return self._versions().get(collection, 0)

    def snapshot(self, collection: str) -> tuple[DataFrame, int]:
        """Locations and version of a collection; a collection that is not there is an error."""
        version = self.version(collection)
        if not version:
            raise KeyError(collection)
        return self.spark.table(self._table(collection, version)), version

    def load_snapshot(self, collection: str, locations: DataFrame, expected: int | None = None) -> int:
        """Writes the next version of a collection and returns its number; expected must be the present one."""
        now = self.version(collection)
        if expected is not None and expected != now:
            raise VersionConflict(f"{collection} is at version {now}, not {expected}")
        locations.write.saveAsTable(self._table(collection, now + 1))
        if now:
            self.spark.sql(f"drop table if exists {self._table(collection, now)}")
        return now + 1

    def drop_collection(self, collection: str) -> bool:
        version = self.version(collection)
        if version:
            self.spark.sql(f"drop table if exists {self._table(collection, version)}")
        return bool(version)

    def stats(self) -> DataFrame:
        """collection_stats of all collections."""
        rows = None
        for name, version in sorted(self._versions().items()):
            one = self.spark.table(self._table(name, version)).select(F.lit(name).alias("collection"), "write_count")
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            rows = self.spark.createDataFrame([], "collection string, write_count double")
        return collection_stats(rows)
