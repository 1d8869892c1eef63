"""Session helpers: a local builder for tests and benches, and lineage cutting through the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("senarai")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; only where it is unset and all executors share this machine (tests) a
    private one. On a cluster without a shared folder this raises, as executors couldn't read each other's files."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="senarai-checkpoint-")
    context.setCheckpointDir(folder)


def shared_place(spark: SparkSession, name: str) -> str:
    """A path for a written table in the shared checkpoint folder, another one at each call."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so a lost executor costs a re-read and not a recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the executors, once a context, for sessions whose workers don't have it installed."""
    context = spark.sparkContext
    if getattr(context, "_senarai_shipped", False):
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="senarai-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, module.relative_to(root.parent))
    context.addPyFile(path)
    context._senarai_shipped = True
