"""What every operator needs of its session: tables, written intermediate tables, shipped code."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_workspaces: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` where the cluster names one.

    Only on a local master, as in tests, a local folder is made if none is set; on a cluster that would
    scatter tables over the executors' own disks, so there an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="scriptorium-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _run_folder(spark: SparkSession) -> str:
    """The folder of the innermost workspace, else the session's own, which goes when the driver ends."""
    if _workspaces:
        return _workspaces[-1]
    base = shared_dir(spark)
    known = getattr(spark, "_scriptorium_folder", None)
    if known is None or not known.startswith(base):
        known = f"{base}/scriptorium/session-{uuid.uuid4().hex}"
        files, where = _file_system(spark, known)
        files.mkdirs(where)
        files.deleteOnExit(where)
        spark._scriptorium_folder = known
    return known


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written within are deleted at its end; results must be written or collected before."""
    path = f"{shared_dir(spark)}/scriptorium/work-{uuid.uuid4().hex}"
    _workspaces.append(path)
    try:
        yield path
    finally:
        _workspaces.remove(path)
        files, where = _file_system(spark, path)
        files.delete(where, True)


def table_path(spark: SparkSession, name: str) -> str:
    """A new place for an intermediate table in the shared folder."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write `df` to the shared folder and read it back.

    Unlike a local checkpoint the written table survives the loss of any executor. It is deleted with
    its `workspace`, or when the driver ends.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package once per session, as they may have no copy of it."""
    if getattr(spark, "_scriptorium_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, f"{_PACKAGE.name}/{path.relative_to(_PACKAGE)}")
    target = os.path.join(tempfile.mkdtemp(prefix="scriptorium-ship-"), f"{_PACKAGE.name}_pkg.zip")
    Path(target).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(target)
    spark._scriptorium_shipped = True


def build_session(app: str = "scriptorium", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; adaptive execution stays on."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
