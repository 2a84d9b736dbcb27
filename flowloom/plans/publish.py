"""Versions of a folder of tables that appear whole or not at all.

A writer claims a version by creating a file that must not exist, writes tables and files under the
version's folder, and last renames a manifest into place. Readers look at versions with a manifest
only, so a writer that broke off leaves nothing visible, and of two that want the same version one
gets the next. The manifest names every table with its rows and digest, and every file with its hash.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


class PublishError(Exception):
    pass


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def digest(table: DataFrame) -> dict:
    """Rows and a checksum that does not depend on their order. Maps count by their sorted entries."""
    plain = [F.sort_array(F.map_entries(c)) if t.startswith("map") else F.col(c) for c, t in table.dtypes]
    found = table.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*plain).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": found["n"], "checksum": str(found["sum"] or 0)}


class Draft:
    """A version being written. Tables are written under its folder; nothing shows before `publish`."""

    def __init__(self, spark: SparkSession, root: str, version: str):
        self.spark, self.root, self.version, self.path = spark, root, version, f"{root}/{version}"
        self.tables: dict[str, dict] = {}

    def write(self, table: DataFrame, name: str) -> DataFrame:
        """Write one table and read it back."""
        table.write.parquet(f"{self.path}/{name}")
        out = self.spark.read.schema(table.schema).parquet(f"{self.path}/{name}")
        self.tables[name] = digest(out)
        return out

    def publish(self, metadata: dict) -> str:
        """Make the version visible. Fails if its manifest is there already."""
        text = json.dumps({"version": self.version, "metadata": metadata, "tables": self.tables}, sort_keys=True)
        store, aside = _store(self.spark, f"{self.path}/_{MANIFEST}")
        _, final = _store(self.spark, f"{self.path}/{MANIFEST}")
        stream = store.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if store.exists(final) or not store.rename(aside, final):
            raise PublishError(f"{self.path} is published already")
        return self.version


def begin(spark: SparkSession, root: str, day: str | None = None) -> Draft:
    """Claim the day's next version: year.month.day, then with .2, .3 and so on."""
    base, n = day or datetime.now(UTC).strftime("%Y.%m.%d"), 1
    while True:
        version = base if n == 1 else f"{base}.{n}"
        store, claim = _store(spark, f"{root}/_claims/{version}")
        if store.createNewFile(claim):
            return Draft(spark, root, version)
        n += 1


def versions(spark: SparkSession, root: str) -> list[str]:
    """Published versions, oldest first."""
    store, at = _store(spark, root)
    if not store.exists(at):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at) if s.isDirectory()]
    found = [n for n in names if store.exists(_store(spark, f"{root}/{n}/{MANIFEST}")[1])]
    return sorted(found, key=lambda v: [int(p) for p in v.split(".")])


class Published(NamedTuple):
    spark: SparkSession
    path: str
    version: str
    metadata: dict
    tables: dict

    def read(self, name: str) -> DataFrame:
        """A table of the version, refused if its rows are not those that were published."""
        table = self.spark.read.parquet(f"{self.path}/{name}")
        if digest(table) != self.tables[name]:
            raise PublishError(f"{name} of {self.version} was changed; refusing to read")
        return table


def open_version(spark: SparkSession, root: str, version: str | None = None) -> Published:
    """A published version, by default the newest."""
    known = versions(spark, root)
    if not known or (version and version not in known):
        raise PublishError(f"no published version {version or ''} at {root}")
    version = version or known[-1]
    try:
        text = spark.read.option("wholetext", True).text(f"{root}/{version}/{MANIFEST}").first()[0]
    except AnalysisException as exc:
        raise PublishError(f"the manifest of {version} cannot be read") from exc
    manifest = json.loads(text)
    return Published(spark, f"{root}/{version}", version, manifest["metadata"], manifest["tables"])
