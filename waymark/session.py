"""What a session needs before the operators run."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, unless their PYTHONPATH has it already."""
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if getattr(context, "_waymark_shipped", False):
        return
    # Executors fetch the file when their first task starts, so it stays until this process ends.
    folder = tempfile.mkdtemp(prefix="waymark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "waymark_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(ROOT.rglob("*")):
            if file.is_file() and "__pycache__" not in file.parts:
                z.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(str(target))
    context._waymark_shipped = True
