"""Session settings and durable intermediate tables."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Folders that the workers import from.
SHIPPED = ("plaudit", "workloads")

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Review texts are long; smaller Arrow batches keep Python workers within their memory.
    _BATCH: "1000",
}


def build_session(
    app: str = "plaudit", master: str | None = None, settings: Mapping[str, str] | None = None
) -> SparkSession:
    """A session with the settings the operators are written for; ``settings`` win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package, and the query modules beside it, importable in the Python workers.

    The modules travel as one archive, so a worker imports them once and its module-level caches
    live as long as the worker. Called again for the same session, it ships nothing.
    """
    if spark.conf.get(_BATCH) == "10000":  # Spark's own default, too much for whole texts
        spark.conf.set(_BATCH, SETTINGS[_BATCH])
    context = spark.sparkContext
    if getattr(context, "_plaudit_shipped", False):
        return
    top = Path(__file__).resolve().parents[2]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name in SHIPPED:
            for path in sorted((top / name).rglob("*.py")):
                archive.writestr(zipfile.ZipInfo(str(path.relative_to(top))), path.read_bytes())
    folder = os.path.realpath(tempfile.mkdtemp(prefix="plaudit-"))
    path = f"{folder}/plaudit-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip"
    Path(path).write_bytes(held.getvalue())
    context.addPyFile(path)  # Spark's driver hands it to the workers
    context._plaudit_shipped = True


def durable_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    On a cluster a warehouse in a local folder is refused: each executor would write to its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")) and _is_local(spark, warehouse):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share; {warehouse} is a local one")
    return f"{warehouse}/_durable"


def _is_local(spark: SparkSession, folder: str) -> bool:
    """Whether a folder lies in the local file system, by its own scheme or the default one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


def durable_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path for an intermediate table."""
    return f"{(folder or durable_folder(spark)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write once to shared storage and read back.

    Cuts the lineage, survives lost executors, and lets every reader prune columns. The table
    stays until its owner removes it: ``durable_files`` tells where it lies, ``remove_durable``
    deletes it.
    """
    path = durable_path(df.sparkSession, name, folder)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_files(df: DataFrame) -> list[str]:
    """The folders of the durable tables that ``df`` reads."""
    return sorted({file.rsplit("/", 1)[0] for file in df.inputFiles()})


def remove_durable(spark: SparkSession, path: str) -> bool:
    """Delete one durable table; False when there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
