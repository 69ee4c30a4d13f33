"""What driver and executors share: this package's sources, and a folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_private: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.  Only a
    local session, where they are one machine, may do without: it gets a private one."""
    global _private
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _private is None:
        _private = tempfile.mkdtemp(prefix="seqloom-")
    return f"file://{_private}"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="seqloom-src-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
