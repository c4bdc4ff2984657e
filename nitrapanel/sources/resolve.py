"""Choice of source by name, with fallback only where data is missing."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from nitrapanel.sources.versions import folder_of, write_version

MISSING = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND")


def resolve(choice: str, sources: dict[str, Callable[[], DataFrame]], say: Callable[[str], None] = print) -> DataFrame:
    """The named source, or for ``auto`` the first one that exists.

    ``auto`` moves on only when a path or table is missing; any other error, and any
    later job failure, is raised as it is.
    """
    if choice != "auto":
        if choice not in sources:
            raise ValueError(f"unknown source {choice!r}; use 'auto' or one of {sorted(sources)}")
        return sources[choice]()
    failed: AnalysisException | None = None
    for name, load in sources.items():
        try:
            return load()
        except AnalysisException as error:
            if error.getCondition() not in MISSING:
                raise
            say(f"source {name} is missing, trying the next one")
            failed = error
    if failed is None:
        raise ValueError("no source registered")
    raise failed


def publish(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """A model under a name of the catalog: as a view, or, with ``root``, as a table with statistics.

    The table's data is a new version below ``root``; the catalog entry is then pointed at
    it and its sizes and column statistics are taken, so that plans that read the name know
    them.  Readers that have started keep the version they have resolved.
    """
    spark = df.sparkSession
    if root is None:
        df.createOrReplaceTempView(name)
        return spark.table(name)
    version = write_version(df, root, name)
    location = folder_of(spark, root, name, version)
    if spark.catalog.tableExists(name):
        if spark.table(name).schema.simpleString() != df.schema.simpleString():
            raise ValueError(f"{name} has other columns: {spark.table(name).schema.simpleString()}")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
        spark.catalog.refreshTable(name)
    else:
        spark.catalog.createTable(name, path=location, source="parquet", schema=df.schema)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.table(name)


def known_rows(spark: SparkSession, name: str) -> int | None:
    """Rows that the catalog knows a table to have; None for a view or without statistics."""
    told = spark.sql(f"DESCRIBE EXTENDED {name}").where("col_name = 'Statistics'").first()
    found = re.search(r"(\d+) rows", told["data_type"]) if told else None
    return int(found[1]) if found else None
