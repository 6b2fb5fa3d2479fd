"""A session with the settings that the plans count on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "siftlake", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, Arrow. On a cluster leave `master` to spark-submit."""
    b = SparkSession.builder.appName(app)
    b = b.master(master) if master else b
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives the workers this package where they wouldn't find it: neither in the folder they start in nor on their path."""
    root = Path(__file__).resolve().parents[1]
    found = {Path.cwd().resolve(), *(Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)}
    if root in found or getattr(spark.sparkContext, "_siftlake_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "siftlake.zip"  # on the driver, which serves it to all workers
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "siftlake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._siftlake_shipped = True
