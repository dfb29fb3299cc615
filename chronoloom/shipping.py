"""Code on executors: queries that run Python there send this package along, so it need not be installed."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_chronoloom_shipped", False):
        return
    root = pathlib.Path(__file__).parent
    at = pathlib.Path(tempfile.mkdtemp(prefix="chronoloom-code-")) / "chronoloom_code.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(at))
    sc._chronoloom_shipped = True
