"""Session factory, shared-folder materialisation and size-checked broadcasts."""

from __future__ import annotations

import atexit
import logging
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("chartloom")


def build_session(app: str = "chartloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; anything in ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, so that they need no installation of it.

    The driver packs it and the application's own file server hands it to executors, late
    ones included.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="chartloom-package-")  # the driver's own: executors fetch the file from it
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "chartloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.join("chartloom", os.path.relpath(os.path.join(at, name), root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a local master, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="chartloom-")
        spark.conf.set("spark.checkpoint.dir", configured)
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, cutting its lineage.

    Unlike a cache this survives the loss of executors. ``release`` removes the files when
    the table is no longer read; what is left goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chartloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a materialised table that nothing reads any more."""
    path = getattr(df, "_written", None)
    if path:
        files, target = _file_system(df.sparkSession, path)
        if not files.delete(target, True):
            LOG.warning("could not remove %s", path)


def broadcast_checked(df: DataFrame, name: str, rows: int) -> DataFrame:
    """``df``, written once, to be broadcast if it has at most ``rows`` rows; beyond that the join is left to shuffle."""
    written = materialise(df, name)
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
