"""Stores on shared storage: entity tables and drift baselines; ``sources.versions`` has versions of a working table.

A store is a folder of parquet tables; listing goes through Spark's own file system, so any
storage the session can read works.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayer.sources.versions import VersionStore   # kept here for its callers


def _path(spark: SparkSession, location: str):
    return spark._jvm.org.apache.hadoop.fs.Path(location)


def _file_system(spark: SparkSession, location: str):
    return _path(spark, location).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, location: str) -> bool:
    return _file_system(spark, location).exists(_path(spark, location))


def folders(spark: SparkSession, location: str) -> list[str]:
    if not exists(spark, location):
        return []
    found = _file_system(spark, location).listStatus(_path(spark, location))
    return sorted(status.getPath().getName() for status in found if status.isDirectory())


def children(spark: SparkSession, location: str) -> list[str]:
    """Names of the finished tables in a folder."""
    return [n for n in folders(spark, location) if exists(spark, f"{location}/{n}/_SUCCESS")]


@dataclass(frozen=True)
class TableStore:
    """One table per name, kept in numbered versions.

    Saving writes the next version and deletes older ones once it is complete, so a table may
    be saved from itself, and a write that breaks off leaves the table as it was.
    """

    spark: SparkSession
    root: str

    def _versions(self, name: str) -> list[int]:
        return sorted(int(v[1:]) for v in children(self.spark, f"{self.root}/{name}") if v[:1] == "v" and v[1:].isdigit())

    def save(self, name: str, df: DataFrame) -> None:
        old = self._versions(name)
        folder = f"{self.root}/{name}"
        taken = [int(v[1:]) for v in folders(self.spark, folder) if v[:1] == "v" and v[1:].isdigit()]
        df.write.mode("errorifexists").parquet(f"{folder}/v{max(taken, default=-1) + 1}")
        for version in old:
            _file_system(self.spark, folder).delete(_path(self.spark, f"{folder}/v{version}"), True)

    def load(self, name: str) -> DataFrame | None:
        versions = self._versions(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{versions[-1]}") if versions else None

    def names(self) -> list[str]:
        return [n for n in folders(self.spark, self.root) if self._versions(n)]

    def delete(self, name: str) -> bool:
        location = f"{self.root}/{name}"
        return bool(_file_system(self.spark, location).delete(_path(self.spark, location), True))


@dataclass(frozen=True)
class BaselineStore:
    """Drift baselines by unique name."""

    spark: SparkSession
    root: str

    @property
    def tables(self) -> TableStore:
        return TableStore(self.spark, self.root)

    def save(self, name: str, statistics: DataFrame) -> None:
        """Insert or replace."""
        self.tables.save(name, statistics.withColumn("created_at", F.current_timestamp()))

    def list(self) -> DataFrame:
        """``(name, created_at)``, newest first."""
        out = self.spark.createDataFrame([], "name string, created_at timestamp")
        for name in self.tables.names():
            out = out.unionByName(self.tables.load(name).agg(F.max("created_at").alias("created_at")).select(F.lit(name).alias("name"), "created_at"))
        return out.orderBy(F.col("created_at").desc())

    def load(self, name: str) -> DataFrame | None:
        return self.tables.load(name)

    def delete(self, name: str) -> bool:
        return self.tables.delete(name)
