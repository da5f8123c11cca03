"""What an operator needs from the session: the shared folder, and tables written to cut lineage.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``: all executors
share it, so the loss of an executor loses nothing.  Only where that is unset and the session is local (tests, a laptop) a
folder of this process is set; on a cluster that is an error.  Nothing is kept on the local disk of one executor.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from seekstone.errors import SeekstoneError

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is set only where none is."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise SeekstoneError(
                f"On {master} the executors share no folder of one machine: set spark.checkpoint.dir to one that all of them see."
            )
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="seekstone-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
            spark.sparkContext.setCheckpointDir(_OWN[app])
        named = _OWN[app]
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; its owner cleans the folder
        pass


@atexit.register
def release() -> None:
    """Delete every table that :func:`materialize` wrote.  Runs at exit; call it earlier once results are stored."""
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted at exit."""
    path = f"{shared_dir(spark)}/seekstone/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, fixes generated ids."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(tables: list[DataFrame]) -> None:
    """Delete stored tables that nothing reads any more, now instead of at exit; others are left alone."""
    for df in tables:
        for file in df.inputFiles():
            folder = file.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/")
            for entry in [e for e in _WRITTEN if e[1].split(":", 1)[-1].lstrip("/") == folder]:
                _delete(*entry)
                _WRITTEN.remove(entry)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, where it isn't installed there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="seekstone-package-")  # read by the driver only, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/seekstone.zip", "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/seekstone.zip")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of too few parts (a single small file, say) to all cores before costly work; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= cores else df.repartition(cores)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
