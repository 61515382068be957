"""Session defaults of the engine."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "gnomon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers that can't see its folder.

    Nothing is done where the folder is on ``PYTHONPATH`` or is the working
    directory; else the package goes to the executors as an archive, once.
    """
    root = Path(__file__).resolve().parent.parent
    seen = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    app = spark.sparkContext.applicationId
    if root in seen or app in _shipped:
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='gnomon-code-')}/gnomon_code", "zip", root, "gnomon")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
