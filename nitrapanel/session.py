"""Session creation and the one way this package cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: int | str = "*", app: str = "nitrapanel", shuffle_partitions: int = 8, scratch: str | None = None
) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own settings.

    ``scratch`` becomes ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("NITRAPANEL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if scratch is not None:
        builder = builder.config("spark.checkpoint.dir", scratch)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is chosen only where the setting is missing and the
    session itself is local; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    chosen = tempfile.mkdtemp(prefix="nitrapanel-")
    context.setCheckpointDir(chosen)
    return chosen


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, grouped by application for later removal."""
    return f"{shared_dir(spark).rstrip('/')}/nitrapanel/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables that this application wrote below the shared folder; call it at its end."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    own = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/nitrapanel/{context.applicationId}")
    own.getFileSystem(context._jsc.hadoopConfiguration()).delete(own, True)


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read on from there.

    Used at the hand-offs (landed feeds, panel, feature store) so that the raw
    tables are scanned once per job, a lost executor costs no re-scan, and later
    joins are planned from the real size of the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Spark serves the archive from the driver, so functions of the package can run in
    tasks when only the driver has it on its path.
    """
    context = spark.sparkContext
    if getattr(context, "_nitrapanel_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="nitrapanel-ship-")), f"nitrapanel-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(archive)
    context._nitrapanel_shipped = True
