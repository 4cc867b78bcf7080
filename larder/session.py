"""Session settings shared by tests, the benchmark and applications."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, for those that don't have it installed; Python processes beside the driver (sources and
    stateful processors have such) find it by its path."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        if root.is_dir():
            known = context.environment.get("PYTHONPATH", "")
            context.environment["PYTHONPATH"] = os.pathsep.join(p for p in (str(root.parent), known) if p)
            base = Path(tempfile.mkdtemp(prefix="larder-code-")) / root.name
            context.addPyFile(shutil.make_archive(str(base), "zip", root.parent, root.name))
        _SHIPPED.add(context.applicationId)


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("larder")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
