"""Session, table access and shared scratch space.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, because it is the only
place that all executors and the driver are sure to share.  A private temporary folder is used only
in local mode, when the setting is absent (tests).
"""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def build_session(app: str = "linkweave", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as a parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_out(rows: DataFrame) -> DataFrame:
    """The rows dealt to four tasks for each core: a table of keys is one small file, which makes one task of all the work that rows stand for."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a private one only in local mode without it."""
    global _own_dir
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="linkweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "table", codec: str = "zstd", instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``instead_of``: an earlier result of this function that nothing else reads; its files are deleted."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if instead_of is not None:
        discard(instead_of)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of results of ``materialize`` that are read no more."""
    for df in tables:
        drop_path(df.sparkSession, df.scratch_path)


_shipped: set[str] = set()

#: Rows in an Arrow batch, where the session says nothing else: rows hold whole texts, and a Python worker holds a batch at a time.
BATCH_ROWS = 1024
_BATCH_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.getConf().get(_BATCH_ROWS_KEY) is None and spark.conf.get(_BATCH_ROWS_KEY) == "10000":  # Spark's own default
        spark.conf.set(_BATCH_ROWS_KEY, str(BATCH_ROWS))
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="linkweave-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "linkweave.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, with the package on the workers before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so that it works in any store."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
