"""Session-level helpers: shared storage, code shipping, table access.

Everything here is driver-side plumbing; no function starts a Spark job except
``materialize``.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()
_cleaned: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, as stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local (tests) a temporary folder takes its place; on a cluster, where executors
    could not read each other's files there, it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='rankloom-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of any executor, and lets
    several later plans use one computation. The files of a session are removed when its driver ends.
    """
    spark = df.sparkSession
    if spark.sparkContext.applicationId not in _cleaned:
        _cleaned.add(spark.sparkContext.applicationId)
        atexit.register(_remove, f"{shared_dir(spark).rstrip('/')}/rankloom/{spark.sparkContext.applicationId}", spark)
    path = f"{shared_dir(spark).rstrip('/')}/rankloom/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(folder: str, spark: SparkSession) -> None:
    """Deletes the intermediate tables of a session, if its JVM still answers."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session has ended; its folder stays for the owner of the storage to clear
        pass


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers.

    Workers inherit the driver's ``PYTHONPATH`` where the folder is shared; on other
    masters the package travels as a zip through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [sc.environment.get("PYTHONPATH", "")])])
    if sc.master.startswith("local"):
        return
    target = Path(tempfile.mkdtemp(prefix="rankloom-src-")) / "rankloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "rankloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
