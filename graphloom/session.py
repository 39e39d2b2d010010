"""Session helpers: session defaults, lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_graphloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="graphloom-")) / "graphloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, Path(root.name) / source.relative_to(root))
    sc.addPyFile(str(archive))
    sc._graphloom_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = spark.conf.get("graphloom.checkpoint.dir", None)
    if not own:
        folder = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = "file://" + folder
        spark.conf.set("graphloom.checkpoint.dir", own)
    return own


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, which outlives lost executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=eager)


def spill_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table into the shared folder and reads it back.

    Columnar and compressed, hence smaller than a checkpoint; also cuts the lineage.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _drop_at_end(df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spill_counted(df: DataFrame, name: str, condition: Column) -> tuple[DataFrame, int]:
    """The same, and how many rows meet a condition, counted while they are written."""
    seen = Observation()
    kept = spill_table(df.observe(seen, F.count_if(condition).alias("n")), name)
    return kept, seen.get["n"]


def _drop_at_end(spark: SparkSession, path: str) -> None:
    """Results read these tables lazily, so they go when the driver ends."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
