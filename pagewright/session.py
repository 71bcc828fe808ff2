"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, so that they need no copy of the repository. Once per context."""
    context = spark.sparkContext
    if getattr(context, "_pagewright_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="pagewright-")
    target = os.path.join(folder, "pagewright.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent).as_posix())
    context.addPyFile(target)
    context._pagewright_shipped = True
