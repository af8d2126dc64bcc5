"""Session defaults."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "tracelake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; on a cluster the master and sizes come from its own configuration."""
    b = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a context: they may run elsewhere, in another folder."""
    sc = spark.sparkContext
    if getattr(sc, "_tracelake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.is_dir():  # from an archive it has been shipped already
        path = Path(tempfile.mkdtemp(prefix="tracelake")) / "tracelake_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        atexit.register(shutil.rmtree, path.parent, ignore_errors=True)
    sc._tracelake_shipped = True
