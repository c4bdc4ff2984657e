"""Versioned tables and manifests below a shared root.

A version is a folder that is written once and never changed; it exists for readers when
its manifest does.  Manifests are small JSON files whose names only ever grow: each is
written aside and renamed into place, which fails if the name is taken, so a reader sees
all of a version or none of it, two writers never share one, and a reader that holds a
version keeps it while later ones are landed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

MANIFESTS, DATA = "_manifests", "data"


def _fs(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    jvm = spark.sparkContext._jvm
    to_path = jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def names(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names in a folder; none if it is missing."""
    fs, to_path = _fs(spark, folder)
    if not fs.exists(to_path(folder)):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(to_path(folder)))


def exists(spark: SparkSession, path: str) -> bool:
    fs, to_path = _fs(spark, path)
    return fs.exists(to_path(path))


def commit(spark: SparkSession, path: str, facts: dict) -> bool:
    """Put a JSON file at ``path`` in one step; False, and nothing changed, if there is one already."""
    fs, to_path = _fs(spark, path)
    folder, name = path.rsplit("/", 1)
    aside = to_path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
    out.close()
    # A rename onto a file fails on some file systems and replaces it on others.
    if not fs.exists(to_path(path)) and fs.rename(aside, to_path(path)):
        return True
    fs.delete(aside, False)
    return False


def read_json(spark: SparkSession, path: str) -> dict | None:
    if not exists(spark, path):
        return None
    fs, to_path = _fs(spark, path)
    stream = fs.open(to_path(path))
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers committed in a folder of manifests, oldest first."""
    return [int(n.split(".")[0]) for n in names(spark, folder) if n.endswith(".json") and not n.startswith(".")]


def versions(spark: SparkSession, root: str, table: str) -> list[int]:
    """Numbers of the table's versions, oldest first."""
    return numbers(spark, f"{root.rstrip('/')}/{table}/{MANIFESTS}")


def manifest(spark: SparkSession, root: str, table: str, version: int) -> dict:
    found = read_json(spark, f"{root.rstrip('/')}/{table}/{MANIFESTS}/{version:08d}.json")
    if found is None:
        raise ValueError(f"{table} has no version {version}")
    return found


def new_folder(root: str, table: str) -> str:
    """Where the data of a next version may be written; nobody reads it before its manifest."""
    return f"{root.rstrip('/')}/{table}/{DATA}/{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that was written but is not to become a version."""
    fs, to_path = _fs(spark, folder)
    fs.delete(to_path(folder), True)


def append(spark: SparkSession, folder: str, facts: dict) -> int:
    """Commit facts under the next number of a folder of manifests."""
    while True:
        number = (numbers(spark, folder) or [0])[-1] + 1
        if commit(spark, f"{folder}/{number:08d}.json", {**facts, "version": number}):
            return number


def publish_folder(spark: SparkSession, root: str, table: str, folder: str, facts: dict | None = None) -> int:
    """Give a written folder the next version number."""
    base = f"{root.rstrip('/')}/{table}"
    return append(spark, f"{base}/{MANIFESTS}", {**(facts or {}), "folder": folder.removeprefix(f"{base}/")})


def folder_of(spark: SparkSession, root: str, table: str, version: int | None = None) -> str:
    """Folder of a version, the newest without a number."""
    if version is None:
        known = versions(spark, root, table)
        if not known:
            raise ValueError(f"{table} has not been landed below {root}")
        version = known[-1]
    return f"{root.rstrip('/')}/{table}/{manifest(spark, root, table, version)['folder']}"


def write_version(df: DataFrame, root: str, table: str, facts: dict | None = None) -> int:
    folder = new_folder(root, table)
    df.write.parquet(folder)
    return publish_folder(df.sparkSession, root, table, folder, facts)


def read_version(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """The table as of a version; what is read is fixed when this is called."""
    return spark.read.parquet(folder_of(spark, root, table, version))


def drop_versions(spark: SparkSession, root: str, table: str, keep: int) -> list[int]:
    """Remove all but the newest ``keep`` versions, manifests first, and folders without a manifest; returns the numbers."""
    base = f"{root.rstrip('/')}/{table}"
    known = versions(spark, root, table)
    gone = known[: max(0, len(known) - max(1, keep))]
    fs, to_path = _fs(spark, base)
    for version in gone:
        fs.delete(to_path(f"{base}/{MANIFESTS}/{version:08d}.json"), False)
    live = {manifest(spark, root, table, v)["folder"] for v in versions(spark, root, table)}
    for name in names(spark, f"{base}/{DATA}"):
        if f"{DATA}/{name}" not in live:
            fs.delete(to_path(f"{base}/{DATA}/{name}"), True)
    return gone
