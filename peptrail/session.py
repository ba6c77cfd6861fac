"""Session helpers: a tuned local session, lineage cuts that survive executor loss, and sizes of plans."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, which may run anywhere; once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_peptrail_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="peptrail-package-")) / "peptrail.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._peptrail_shipped = True


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("peptrail")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is an error, as a folder of one machine would
    be lost with it.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if not known.isEmpty():
        return known.get()
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="peptrail-checkpoint-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: an eager, reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Estimates from here on stand for an unknown size (a DataFrame made of local rows or an RDD).
UNKNOWN_BYTES = 1 << 60


def reduce_partitions(df: DataFrame, bytes_each: int = 64 << 20) -> int:
    """Partitions for a reduction over df: the session's shuffle partitions, more where the input is known to be large."""
    n, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), plan_bytes(df)
    return n if size >= UNKNOWN_BYTES else max(n, min(20_000, size // bytes_each))
