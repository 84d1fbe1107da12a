"""Session helpers shared by the library, the tests and the benchmark."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(app: str = "traceframe", cpus: int | None = None, **conf: str) -> SparkSession:
    """A ``local[n]`` session with the settings the library expects (UTC, AQE, Arrow)."""
    master = f"local[{cpus}]" if cpus else "local[*]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cpus or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRACEFRAME_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers of the application, once.

    Needed where the package is not installed on them: functions are pickled by name. Spark's own file service
    carries the archive; the workers need no folder in common with the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}-code", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster, or a fresh local one when none is named."""
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    return tempfile.mkdtemp(prefix="traceframe-ckpt-")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/traceframe-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to shared storage and read back: computed a single time, columnar, and safe when
    executors are lost (unlike a local checkpoint)."""
    folder = scratch_folder(df.sparkSession)
    df.write.parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    written._scratch = folder
    return written


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the library's own below the shared folder, whatever store it is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*written: DataFrame | None) -> None:
    """Delete what ``cut_lineage`` wrote, once nothing reads it any more; None and other frames are left alone."""
    for df in written:
        folder = vars(df).get("_scratch") if df is not None else None
        if folder:
            remove_folder(df.sparkSession, folder)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over all cores when the input has fewer splits than cores, else unchanged.

    Meant right behind a source, in front of work bound by CPU (parsing, many regexes), on small or
    unsplittable input; on large input it adds nothing.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_splits(df) < cores else df


def input_splits(df: DataFrame) -> int:
    """Number of scan tasks the plan starts with; planned only, nothing runs."""
    return df.rdd.getNumPartitions()
