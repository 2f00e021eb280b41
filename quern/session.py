"""A session with the settings the engine expects; clusters bring their own and need none of this."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quern")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one on a local master without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or getattr(spark.sparkContext, "_quern_shared", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = spark.sparkContext._quern_shared = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
    return found.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session; they may run from any folder."""
    sc = spark.sparkContext
    if getattr(sc, "_quern_shipped", False):
        return
    import shutil
    from pathlib import Path

    package = Path(__file__).parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/quern", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    sc._quern_shipped = True
