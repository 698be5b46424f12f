"""Several tables that change together: folders of data, and a manifest that says which of them count.

A writer puts every table into a new folder, then creates the next manifest: one small file that names the folders. Creating
it is the commit, exclusive and atomic, so readers see all tables as one version or as the one before; what a failed job
wrote is named nowhere. Two writers of one version: the second finds the file there and fails (``Conflict``), to start
again from what the first committed. Paths and the manifest go through Hadoop's file system, as the data do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def versions(spark: SparkSession, base: str) -> list[int]:
    """The numbers of the manifests under ``base``, ascending (also of one that its writer did not finish)."""
    fs, p = _fs(spark, f"{base}/_manifest")
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit())


def read_manifest(spark: SparkSession, base: str, version: int) -> dict | None:
    """The manifest of a version, None if it is not there or not whole."""
    fs, p = _fs(spark, f"{base}/_manifest/{version}.json")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def latest(spark: SparkSession, base: str, before: int | None = None) -> tuple[int, dict] | None:
    """The newest whole manifest (below ``before``, if given) with its version."""
    for v in reversed(versions(spark, base)):
        if before is None or v < before:
            found = read_manifest(spark, base, v)
            if found is not None:
                return v, found
    return None


def create_manifest(spark: SparkSession, base: str, version: int, content: dict, replace: bool = False) -> None:
    """Commit: create the manifest of ``version``. ``replace``: a replayed writer may create its own once more."""
    fs, p = _fs(spark, f"{base}/_manifest/{version}.json")
    try:
        out = fs.create(p, replace)
    except Exception as e:  # the file system's own exception, by name: it comes over the gateway
        if "AlreadyExists" in str(e) or "already exists" in str(e):
            raise Conflict(f"version {version} of {base} is committed") from None
        raise
    try:
        out.write(bytearray(json.dumps(content).encode("utf-8")))
    finally:
        out.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


class TableSet:
    """Named tables under one folder that are read and changed as one version."""

    def __init__(self, spark: SparkSession, base: str, schemas: dict[str, str]):
        self.spark, self.base, self.schemas = spark, base.rstrip("/"), schemas

    def read(self, version: int | None = None) -> tuple[int, dict[str, DataFrame]]:
        """(version, tables): the newest version, or an older one; -1 and empty tables before the first commit."""
        if version is None:
            at = latest(self.spark, self.base)
        else:
            found = read_manifest(self.spark, self.base, version)
            if found is None:
                raise ValueError(f"{self.base} has no version {version}")
            at = version, found
        if at is None:
            return -1, {n: self.spark.createDataFrame([], s) for n, s in self.schemas.items()}
        parts = at[1]["tables"]
        return at[0], {n: self.spark.read.schema(s).parquet(*parts[n]) if parts.get(n) else
                       self.spark.createDataFrame([], s) for n, s in self.schemas.items()}

    def commit(self, version: int, appended: dict[str, DataFrame] | None = None,
               replaced: dict[str, DataFrame] | None = None) -> int:
        """Write what changes and commit it as the version after ``version`` (the one it was derived from): tables to
        append to keep their folders and get one more, others are replaced. The rest stays as it is."""
        base = read_manifest(self.spark, self.base, version) if version >= 0 else None
        tables = dict((base or {"tables": {}})["tables"])
        for changed, keep in ((appended or {}, True), (replaced or {}, False)):
            for name, df in changed.items():
                path = f"{self.base}/{name}/{uuid.uuid4().hex}"
                df.write.parquet(path)
                tables[name] = (tables.get(name, []) if keep else []) + [path]
        number = max([version, *versions(self.spark, self.base)]) + 1
        if any(read_manifest(self.spark, self.base, v) is not None for v in range(version + 1, number)):
            raise Conflict(f"{self.base} went on from version {version}")
        create_manifest(self.spark, self.base, number, {"tables": tables})
        return number

    def change(self, fn: Callable[[dict[str, DataFrame]], tuple[dict, dict]], attempts: int = 5) -> int:
        """Commit ``fn(tables) -> (appended, replaced)``; if another writer was first, once more on its version."""
        for left in reversed(range(attempts)):
            version, tables = self.read()
            try:
                return self.commit(version, *fn(tables))
            except Conflict:
                if not left:
                    raise
        raise AssertionError
