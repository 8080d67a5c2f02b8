"""The library on the workers of a cluster that does not have it installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import linkloom


def ship(spark: SparkSession) -> str:
    """Send this package's source to all executors, present and future ones; the path of the archive.

    Arrow functions are pickled by module name, so workers must be able to import
    them. Not needed where the package is installed on every node, or where
    ``spark.submit.pyFiles`` names it.
    """
    root = Path(linkloom.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="linkloom-")) / "linkloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path("linkloom") / file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    return str(archive)
