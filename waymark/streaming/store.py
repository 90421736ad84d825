"""Generations of tables beside a manifest: a generation counts once its manifest row is there."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only where it is unset on a local master, as in tests, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="waymark-")
    return "file://" + _own[app]


def written(df: DataFrame) -> DataFrame:
    """df, written once into the shared folder and read back: what follows neither computes it again nor depends on lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class GapError(RuntimeError):
    """A batch that doesn't follow the last committed one."""


class Store:
    """Named tables in immutable generations. Readers see the last generation of which the manifest tells.

    views: tables that follow from a generation's others by name; they are made when they are read, not written.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark, self.folder = spark, folder or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        self.views: dict[str, Callable[[], DataFrame]] = {}

    def _manifest(self) -> DataFrame:
        return self.spark.read.schema("version LONG, generation STRING, tables STRING").json(f"{self.folder}/manifest")

    def version(self) -> int:
        """The last committed version, -1 before the first."""
        try:
            return self._manifest().agg(F.coalesce(F.max("version"), F.lit(-1))).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return -1
            raise

    def commit(self, version: int, tables: dict[str, DataFrame], gap: bool = False) -> None:
        """Write the tables, then the manifest row. A version that was committed before is left as it is; a gap is an error, if it isn't allowed."""
        last = self.version()
        if version <= last:
            return
        if version != last + 1 and not gap:
            raise GapError(f"version {version} after {last}")
        generation = f"{version:09d}-{uuid.uuid4().hex[:8]}"  # a failed attempt's files are never read
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{generation}/{name}")
        row = self.spark.createDataFrame([(version, generation, ",".join(sorted(tables)))], "version LONG, generation STRING, tables STRING")
        row.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def read(self, name: str) -> DataFrame:
        if name in self.views:
            return self.views[name]()
        generation = self._manifest().orderBy(F.desc("version")).first()["generation"]
        return self.spark.read.parquet(f"{self.folder}/{generation}/{name}")

    def stale(self, keep: int = 2) -> list[str]:
        """Generations that retention may drop: all but the last `keep`."""
        rows = self._manifest().orderBy(F.desc("version")).select("generation").collect()  # a row a commit
        return [r[0] for r in rows[keep:]]
