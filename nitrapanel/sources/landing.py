"""Landing raw feeds as versions of Parquet tables with provenance, and reading tables back."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitrapanel.constants import KEY
from nitrapanel.sources.versions import drop_folder, new_folder, publish_folder, read_version


def stamp(feed: DataFrame, **provenance: str) -> DataFrame:
    """Constant provenance columns plus the load time."""
    for name, value in provenance.items():
        feed = feed.withColumn(name, F.lit(value))
    return feed.withColumn("loaded_at", F.current_timestamp())


def table_path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


def land_raw(feed: DataFrame, root: str, table: str, **provenance: str) -> DataFrame:
    """Land one table in full as its next version; an empty feed is refused.

    Earlier versions stay as they are for whoever reads them.  A feed may be a join or an
    aggregation of large tables: it runs once, and what it wrote is looked at before it
    becomes a version.
    """
    spark, stamped, folder = feed.sparkSession, stamp(feed, **provenance), new_folder(root, table)
    stamped.write.parquet(folder)
    if spark.read.schema(stamped.schema).parquet(folder).isEmpty():
        drop_folder(spark, folder)
        raise RuntimeError(f"{table}: feed has 0 rows, refusing to write an empty table")
    version = publish_folder(spark, root, table, folder, {"provenance": provenance})
    return read_version(spark, root, table, version)


def report(table: str, landed: DataFrame, period: str = "period") -> DataFrame:
    """One line per table: row count and first and last period."""
    return landed.agg(
        F.count("*").alias("n_rows"),
        F.min(period).cast("date").alias("first_period"),
        F.max(period).cast("date").alias("last_period"),
    ).select(F.lit(table).alias("table_name"), "n_rows", "first_period", "last_period")


def land_all(
    registry: dict[str, Callable[[], DataFrame]],
    root: str,
    only: Iterable[str] | None = None,
    provenance: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """Land the registered feeds in order (or those in ``only``) and report each.

    Any failure propagates; nothing after it is landed.
    """
    wanted = list(registry) if only is None else [t for t in registry if t in set(only)]
    if not wanted:
        raise ValueError("no registered table selected")
    lines = []
    for table in wanted:
        landed = land_raw(registry[table](), root, table, **(provenance or {}).get(table, {}))
        lines.append(report(table, landed))
    out = lines[0]
    for line in lines[1:]:
        out = out.unionByName(line)
    return out


def column_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows, non-null values per column and the month range."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in cols])


def scan(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Projection of a stored table with doubles cleaned of NaN."""
    df = spark.read.parquet(path).select(*cols)
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in floats else F.col(c) for c in cols])


def write_feature_store(features: DataFrame, path: str, by_series: bool = False) -> None:
    """Feature store as Parquet.

    Features leave their window sorted by series, so file statistics already prune by
    series. A directory per series (``by_series``) only suits a handful of series.
    """
    writer = features.write.mode("overwrite")
    (writer.partitionBy(KEY) if by_series else writer).parquet(path)


def read_feature_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
