"""Session helpers shared by operators: table access and fault-tolerant lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if _shipped.get(sc.applicationId):
        return
    package = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="strandline-")  # read by the driver alone, which serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "strandline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped[sc.applicationId] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _local_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine, removed at exit; only where all tasks run on this machine too."""
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    folder = tempfile.mkdtemp(prefix=f"strandline-{name}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only in local mode and where
    that is unset (tests, a laptop) a temporary folder of this machine is used.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_local_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for a new folder of files that other tasks read, removed when the application ends: in the shared checkpoint folder, or (in local mode without one) on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        return f"{_local_folder(spark, name)}/files"
    folder = f"{base.rstrip('/')}/strandline-{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{folder}/files"


def spread(scan: DataFrame) -> DataFrame:
    """A scan before a costly Python stage, in as many partitions as there are cores if its files give fewer than half as many.

    Only tables of so few row groups are moved; others are read where they are split. ``scan`` must not shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if 2 * scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; stops counting one row beyond."""
    return df.limit(rows + 1).count() <= rows
